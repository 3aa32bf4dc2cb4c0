"""Values that results depend on."""

# The stop words that must be left out for equal keyword results.
STOPWORDS = tuple(
    """a about after all also am an and any are as at back be because been before being but by can cant cannot
    come could day did didnt do does doesnt doing dont down each even every for from get gets getting give go going
    good got had has have having he her here hers him his how i id if ill im in into is isnt it its ive just keep
    know last let like ll made make makes many may me more most much my need never new no not now of off on once
    one only or other our out over own really re said same say see she should since so some still such take than
    that thats the their them then there these they thing things this those though through time to too try
    up us use used using ve very want was wasnt way we well went were what when where which while who why will with
    without wont would yet you your youre app apps application download downloaded install installed iphone ipad
    ios apple store version update updated please thank thanks""".split()
)

# Theme names and patterns, in the order that breaks ties. Matched without case, anywhere in the text.
THEMES = (
    ("Billing & subscriptions", r"subscri|billing|charge|charged|refund|cancel|auto.?renew|money back|paid twice|payment"),
    ("Price & value", r"\bprice|pricey|expensive|overpriced|too much money|not worth|rip.?off|scam|waste of money|free trial"),
    ("Paywall & onboarding", r"paywall|pay.?wall|sign.?up|onboarding|questions before|force|forced|must pay|before you can"),
    ("Stability & crashes", r"crash|freez|frozen|stuck|glitch|\bbug|broken|not working|doesn.?t work|error|black screen"),
    ("Performance & speed", r"\bslow|lag|laggy|loading|takes forever|battery|drain|heavy"),
    ("Account & login", r"\blog ?in|\blogin|sign.?in|password|\baccounts?\b|restore purchase|log ?out"),
    ("Ads & notifications", r"\bads?\b|advert|pop.?up|spam|notification|too many emails"),
    ("Customer support", r"support|customer service|no response|nobody|contact|help me|ignored|reply"),
    ("Content quality & accuracy", r"inaccurate|generic|wrong|not accurate|copy.?paste|same answer|fake|bot|chat.?gpt|ai generated|advisor|psychic|expert"),
)

#: Our own advice for each theme.
ADVICE = {
    "Billing & subscriptions": "State price, renewal date and how to cancel next to the buy button, and make refunds quick.",
    "Price & value": "Offer a smaller plan and let people see what they pay for first.",
    "Paywall & onboarding": "Ask less before the first useful result, and show the price early.",
    "Stability & crashes": "Reproduce the reported flows and put a fix release before new features.",
    "Performance & speed": "Measure the slow screens on old devices and cut what blocks them.",
    "Account & login": "Test sign-in and restoring purchases on every release.",
    "Ads & notifications": "Limit how often promotions appear and let people choose what they are told.",
    "Customer support": "Promise an answer within a stated time and keep to it.",
    "Content quality & accuracy": "Check answers against a reviewed set and say where they come from.",
}

SENTIMENTS = ("positive", "neutral", "negative")
EXPORT_COLUMNS = ("id", "rating", "title", "text", "author", "version", "updated", "votes", "sentiment", "sentiment_score", "has_complaint", "sentiment_source")
