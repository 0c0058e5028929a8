"""Fixed values of the support-queue domain."""

# Content types and the key prefix each one carries.
POST, ARTICLE, COMMENT = "post", "article", "comment"

# Network roles that count as staff.
STAFF_ROLES = ("host", "moderator")

# Ticket statuses.
MANUAL_STATUSES = ("open", "closed", "cancelled")
FEEDBACK_STATUSES = ("not_a_question", "confirmed_question")
QUICK_STATUSES = ("open", "assigned", "answered", "closed", "cancelled", "flagged")
OPEN_SET = ("open", "new", "assigned")
RESOLVED_SET = ("answered", "closed")

# Old status name -> current name.
STATUS_RENAMES = {"open": "new", "in_progress": "assigned", "answered": "closed"}

# Urgency by whole-hour age: below 24 normal, below 48 urgent, else critical.
URGENT_FROM_HOURS = 24
CRITICAL_FROM_HOURS = 48
URGENCY_RANK = {"normal": 0, "urgent": 1, "critical": 2}

# Tickets a team means to answer per day, and the response-time promise.
DAILY_GOAL = 50
RESPONSE_TARGET_MINUTES = 1440

# Preview lengths: list row, group row, feedback digest line.
LIST_PREVIEW = 120
GROUP_PREVIEW = 300
DIGEST_PREVIEW = 350

# Feedback digest: rows per section, gate, window, fixed texts.
DIGEST_REJECTS = 20
DIGEST_CONFIRMED = 10
FEEDBACK_GATE = 5
FEEDBACK_DAYS = 7
MIN_PROMPT_LENGTH = 50
NO_CHANGE = "no change"
DIGEST_REJECT_HEADER = "## FALSE POSITIVES\n"
DIGEST_CONFIRMED_HEADER = "\n\n## CONFIRMED QUESTIONS\n"
DIGEST_EMPTY = "  (none this week)"
DIGEST_TYPE, DIGEST_TEXT, DIGEST_NOTE = "Type: ", " | Text: ", " | Team note: "

# Topic labels, in the order ties are settled; the last one is the fallback.
TOPICS = (
    "Pay Debt & Bills",
    "Home & Housing Help",
    "Cars & Car Repairs",
    "Healthcare Assistance",
    "Start A Business",
    "Launch A Nonprofit",
    "Boost Your Career",
    "Taxes Help Guidance",
    "Find Legal Help",
    "Family & Children",
    "Seniors & Disabilities",
    "Programs for Veterans",
    "Community Support",
    "Other",
)
FALLBACK_TOPIC = TOPICS[-1]
TOPIC_REQUEST = 'Name the one topic that fits this question best, as JSON {"domain": "..."}. Topics: '

# Words that speak for a topic in the built-in dictionary labeller.
TOPIC_WORDS = {
    "Pay Debt & Bills": ("debt", "bill", "bills", "loan", "credit", "payment"),
    "Home & Housing Help": ("home", "house", "housing", "rent", "mortgage", "roof"),
    "Cars & Car Repairs": ("car", "cars", "vehicle", "repair", "repairs", "truck"),
    "Healthcare Assistance": ("health", "medical", "doctor", "dental", "hospital", "insurance"),
    "Start A Business": ("business", "startup", "company", "entrepreneur"),
    "Launch A Nonprofit": ("nonprofit", "charity", "foundation"),
    "Boost Your Career": ("career", "job", "training", "school", "college", "work"),
    "Taxes Help Guidance": ("tax", "taxes", "irs", "refund"),
    "Find Legal Help": ("legal", "lawyer", "attorney", "court", "license"),
    "Family & Children": ("family", "child", "children", "kids", "baby", "parent"),
    "Seniors & Disabilities": ("senior", "seniors", "disability", "disabled", "elderly"),
    "Programs for Veterans": ("veteran", "veterans", "military", "army"),
    "Community Support": ("login", "zoom", "replay", "billing", "password", "email"),
}
