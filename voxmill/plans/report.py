"""Insights as Markdown or a page of HTML without scripts."""

from __future__ import annotations

from html import escape


def _bar(share: float) -> str:
    return f"<div style='background:#48c;height:.7em;width:{max(0.6, share):.1f}%'></div>"


def markdown(app: dict, insights: dict) -> str:
    m, s = insights["metrics"], insights["sentiment"]
    lines = [f"# Reviews of {app.get('name', app.get('app_id', ''))}", "", insights["summary"], "", "## Ratings", "", "| stars | reviews | share |", "| - | - | - |"]
    lines += [f"| {stars} | {v['count']} | {v['percentage']}% |" for stars, v in m["rating_distribution"].items()]
    lines += ["", "## Sentiment", ""] + [f"- {c}: {s['counts'][c]} ({s['percentages'][c]}%)" for c in s["counts"]]
    lines += ["", "## Terms of complaints", ""] + [f"- {k['term']} ({k['count']})" + (f", z {k['z_score']}" + ("" if k["significant"] else ", not significant") if "z_score" in k else "") for k in insights["negative_keywords"]]
    lines += ["", "## Themes", ""]
    for t in insights["themes"]:
        lines += [f"### {t['theme']}", "", f"{t['negative_reviews']} reviews, {t['share_of_negative']}% of complaints. {t['recommendation']}", ""] + [f"> {q[:280]}" for q in t.get("sample_quotes", [])] + [""]
    lines += ["## What to do", ""] + [f"- {a}" for a in insights["actionable_insights"]]
    return "\n".join(lines) + "\n"


def html(app: dict, insights: dict) -> str:
    m, s = insights["metrics"], insights["sentiment"]
    e = lambda x: escape(str(x))
    rows = "".join(f"<tr><td>{e(k)}</td><td>{e(v['count'])}</td><td style='width:60%'>{_bar(v['percentage'])}</td></tr>" for k, v in m["rating_distribution"].items())
    moods = "".join(f"<tr><td>{e(c)}</td><td>{e(s['counts'][c])}</td><td style='width:60%'>{_bar(s['percentages'][c])}</td></tr>" for c in s["counts"])
    terms = "".join(f"<li>{e(k['term'])} ({e(k['count'])})</li>" for k in insights["negative_keywords"])
    found = "".join(f"<h3>{e(t['theme'])}</h3><p>{e(t['negative_reviews'])} reviews, {e(t['share_of_negative'])}%. {e(t['recommendation'])}</p>" + "".join(f"<blockquote>{e(q)}</blockquote>" for q in t.get("sample_quotes", [])) for t in insights["themes"])
    actions = "".join(f"<li>{e(a)}</li>" for a in insights["actionable_insights"])
    name = e(app.get("name", app.get("app_id", "")))
    return f"<!doctype html><meta charset='utf-8'><title>{name}</title><body style='font-family:sans-serif;max-width:50em;margin:auto'><h1>{name}</h1><p>{e(insights['summary'])}</p><h2>Ratings</h2><table style='width:100%'>{rows}</table><h2>Sentiment</h2><table style='width:100%'>{moods}</table><h2>Terms of complaints</h2><ul>{terms}</ul><h2>Themes</h2>{found}<h2>What to do</h2><ul>{actions}</ul></body>\n"
