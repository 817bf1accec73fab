"""Word lists, patterns and rule tables that results depend on.

Everything here is data.  The operators take rules as parameters, so another domain brings its own tables.
"""
from __future__ import annotations

from typing import NamedTuple

# Words ignored in keyword extraction.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were",
    "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "this",
    "that", "these", "those", "it", "its", "they", "their", "we", "our", "you", "your", "he", "she", "his", "her", "all", "any",
    "each", "both", "more", "most", "other", "some", "such", "into", "about", "up", "out", "as", "if", "then", "than", "so", "no",
    "not", "also", "which", "who", "what", "how", "when", "where", "why", "can", "page", "click", "here", "read", "view",
)

# Whole-text patterns of navigation and legal remnants.
BOILERPLATE_PATTERNS = (
    r"(?i)^(home|back|next|previous|menu|navigation|click here|read more|learn more|see all)$",
    r"(?i)^(copyright|all rights reserved|terms|privacy|cookie)",
    r"^\s*\|\s*$",
)

# Query parameters that only track the visitor.
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "referrer",
                       "fbclid", "gclid", "sessionid", "session_id", "_ga", "mc_cid", "mc_eid")

# Files that hold no text.
MEDIA_FILE_PATTERN = r"(?i)\.(jpg|jpeg|png|gif|svg|ico|css|js|woff|ttf|eot|mp4|avi|zip|rar)(\?.*)?$"

# URLs never followed.
DENY_URL_PATTERNS = (
    r"(?i)\.(jpg|jpeg|png|gif|svg|ico|css|js|woff|woff2|ttf|eot|mp4|mp3|avi|zip|rar|tar|gz)(\?.*)?$",
    r"(?i)/(wp-admin|wp-login|wp-cron|feed|rss|sitemap\.xml|robots\.txt)",
    r"(?i)/(login|logout|register|cart|checkout|account)",
    r"(?i)(facebook|twitter|youtube|linkedin|instagram|whatsapp)\.com",
    r"(?i)mailto:|tel:|javascript:|#$",
)

# Message patterns.
GREETING_PATTERN = (r"(?i)^(hey|hi|hello|salam|assalam|dear|helo|hii|howdy|good morning|good evening|"
                    r"good afternoon)[\s!.،]*$")
NEGATIVE_ANSWER_PATTERN = (r"(?i)don't have info|don't know|not found|معذرت|پاس معلومات نہیں|"
                           r"تصدیق شدہ معلومات نہیں")
LIST_QUERY_PATTERN = r"(?i)all|list|multiple|who are|teachers|faculty|professors|staff|courses|programs"
TIME_QUERY_PATTERN = r"(?i)latest|recent|today|new|current|this week|this month|2024|2025|2026"
STAGE_TOPIC_PATTERN = r"(?i)admission|apply|enroll|eligib|entry test|fee|scholarship"
STAGE_TOPIC_SUFFIX = " details requirements process"
SYNONYM_TRIGGER_PATTERN = r"(?i)\b(dental|bds|pharmacy|nursing|cs|bba)\b"
CORRECTION_WORDS = ("wrong", "incorrect", "غلط", "درست نہیں")
PERSONA_PATTERNS = (("visitor", r"apply|admission|fee|program"), ("student", r"exam|result|course|schedule|semester"))
FILLER_WORDS = (
    "the", "a", "an", "is", "are", "what", "whats", "tell", "me", "about", "please", "kindly", "can", "you", "i", "want", "to",
    "know", "of", "for", "in",
)

# Intents in order of precedence, with their keywords.
INTENT_KEYWORDS = (
    ("admission_inquiry", ("admit", "admission", "apply", "application", "enroll", "entry test", "eligibility",
                           "requirements", "form", "last date")),
    ("fee_inquiry", ("fee", "fees", "cost", "charges", "tuition", "payment", "installment", "how much", "price")),
    ("scholarship_inquiry", ("scholarship", "financial aid", "merit", "stipend", "bursary", "discount", "waiver",
                             "free")),
    ("program_inquiry", ("program", "degree", "course", "department", "bachelor", "master", "bs", "bsc", "ms", "msc",
                         "phd", "what do you offer")),
    ("career_inquiry", ("job", "career", "placement", "employment", "salary", "after graduation", "industry")),
    ("faculty_hiring", ("teach", "lecturer", "professor", "faculty", "vacancy", "hiring", "job opening",
                        "join as teacher")),
    ("hostel_inquiry", ("hostel", "accommodation", "dorm", "dormitory", "living", "room", "stay", "residential")),
    ("contact_inquiry", ("contact", "phone", "email", "address", "location", "where", "visit", "find you",
                         "directions", "map")),
    ("faculty_inquiry", ("who is", "tell me about", "profile", "teacher", "professor", "lecturer", "staff", "faculty",
                         "researcher", "cv", "doctor", "dr.", "qualification")),
)

# Synonyms for query expansion.
SYNONYMS = (
    ("dental", ("bds", "dentistry", "dental surgery", "dental science", "oral medicine")),
    ("bds", ("dental", "dentistry", "dental surgery", "oral medicine")),
    ("pharmacy", ("pharm-d", "pharmacology", "pharma", "d-pharm")),
    ("cs", ("computer science", "it", "information technology", "software engineering", "bscs", "mscs")),
    ("it", ("information technology", "computer science", "cs", "bsit")),
    ("bba", ("business", "management", "mba", "commerce", "finance")),
    ("nursing", ("bsn", "medical assistant", "nurse")),
    ("admission", ("apply", "enroll", "entry test", "last date", "eligibility", "form", "intake")),
    ("fee", ("charges", "payment", "tuition", "cost", "dues", "scholarship")),
)

# The shorter synonym table used when a retrieval is repeated.
RETRY_SYNONYMS = (
    ("dental", ("bds", "dentistry", "dental surgery", "dental science", "oral medicine")),
    ("bds", ("dental", "dentistry", "dental surgery", "oral medicine")),
    ("pharmacy", ("pharm-d", "pharmacology", "pharma")),
    ("cs", ("computer science", "it", "information technology", "software engineering")),
    ("bba", ("business", "management", "mba", "commerce")),
    ("nursing", ("bsn", "medical assistant")),
    ("admission", ("apply", "enroll", "entry test", "last date", "eligibility")),
    ("fee", ("charges", "payment", "tuition", "scholarship")),
)


class Rule(NamedTuple):
    """One rule: a case-insensitive pattern and the labels it gives."""

    pattern: str
    labels: tuple[str, ...]


# Query patterns and the namespaces each adds.
ROUTING_RULES = (
    Rule(r"facult|staff|professor|lecturer|instructor|teacher|bio|cv|dr\.|prof\.|hod|dean|who is|tell me about|"
         r"profile|details of", ("faculty",)),
    Rule(r"who is|tell me about", ("alumni",)),
    Rule(r"admiss|apply|enroll|eligib|entry test|last date|intake|form", ("admissions",)),
    Rule(r"scholarship|financial.?aid|merit|bursary|stipend|waiver", ("scholarships",)),
    Rule(r"fee|tuition|cost|charges?|payment|installment|dues|how much", ("finance",)),
    Rule(r"notice|announcement|news|circular|latest|recent|update", ("notices",)),
    Rule(r"event|seminar|workshop|conference|ceremony|convocation", ("events",)),
    Rule(r"policy|rule|regulation|handbook|code.?of.?conduct|slc|student.?handbook", ("policies", "student-handbook")),
    Rule(r"exam|examination|grading|gpa|marks|result", ("examination", "academic")),
    Rule(r"contact|phone|email|address|location|reach|visit|map|directions", ("contact",)),
    Rule(r"department|dept|all department|faculties|our department|list of department",
         ("departments", "academic", "faculty")),
    Rule(r"\b(cs|bscs|mscs|software|computer.?science|it|bsit)\b", ("dept-cs",)),
    Rule(r"\b(bba|mba|business|management|commerce)\b", ("dept-bba",)),
    Rule(r"pharm", ("dept-pharmacy",)),
    Rule(r"nurs", ("dept-nursing",)),
    Rule(r"program|degree|course|curriculum|syllabus|semester|credit|cdc|career development", ("academic",)),
    Rule(r"alumni|graduate|former student|gold.?medal|medal.?list|medalist|topper|batch.?20|20\d\d.?batch|"
         r"convocation|award.?winner|best.?student|distinction|position.?holder|first.?position|second.?position|"
         r"third.?position", ("alumni",)),
    Rule(r"\b(dental|bds|dentistry|oral)\b", ("admissions", "academic")),
)
DEFAULT_NAMESPACE = "general"


# Page rules; labels are page type, category, department.
PAGE_RULES = (
    Rule(r"alumni", ("alumni", "Alumni", "general")),
    Rule(r"admiss?ions?|apply|application|enroll|register", ("admissions", "Admissions", "general")),
    Rule(r"scholarship|financial.?aid|bursary|stipend|merit", ("scholarship", "Scholarship", "general")),
    Rule(r"notice|announcement|news|circular|bulletin|press.?release", ("notice", "Notice", "general")),
    Rule(r"event|seminar|workshop|conference|ceremony|convocation|webinar", ("event", "Events", "general")),
    Rule(r"faculty|staff|professor|lecturer|instructor|dean|rector|director", ("faculty", "Faculty", "general")),
    Rule(r"policy|policies|rule|regulation|handbook|bylaw|procedure|code.?of.?conduct",
         ("policy", "Policy", "general")),
    Rule(r"fee|tuition|charges?|payment|finance|cost|dues|prospectus", ("academic", "Finance", "general")),
    Rule(r"contact|location|address|map|phone|email|reach.?us", ("contact", "Contact", "general")),
    Rule(r"facility|facilities|hostel|transport|library|sports|cafeteria|lab", ("general", "Facilities", "general")),
    Rule(r"\b(cs|cse|it|software.?eng|computer.?science|information.?technology|bscs|bsit|bsse)\b", ("department", "CS & IT", "cs_it")),
    Rule(r"\b(bba|mba|business.?admin|management|commerce|bs.?business)\b", ("department", "BBA", "bba")),
    Rule(r"pharm(acy|acology|d)|d\.pharm", ("department", "Pharmacy", "pharmacy")),
    Rule(r"nurs(ing|e)|midwifery|bs.?nursing", ("department", "Nursing", "nursing")),
    Rule(r"academic|curriculum|course|syllabus|semester|timetable|schedule|credit|degree|program",
         ("academic", "Academic", "general")),
)
PAGE_DEFAULT = ("general", "General", "general")
# What marks a page as a personal profile, and the department a profile belongs to.
PROFILE_URL_PART = "profile.php"
PROFILE_PATTERN = r"professor|lecturer|instructor|dean"
PROFILE_DEPARTMENTS = (
    Rule(r"\b(cs|cse|it|software.?eng|computer.?science|information.?technology|bscs|bsit|bsse)\b", ("cs_it",)),
    Rule(r"\b(bba|mba|business.?admin|management|commerce|bs.?business)\b", ("bba",)),
    Rule(r"pharm(acy|acology|d)|d\.pharm", ("pharmacy",)),
    Rule(r"nurs(ing|e)|midwifery", ("nursing",)),
)

# Chunk rules; labels are category, namespace, page type.
CHUNK_RULES = (
    Rule(r"scholarship|financial[\s.-]?aid|merit\s+award|stipend|bursary|need[\s-]?based",
         ("Scholarship", "scholarships", "scholarship")),
    Rule(r"hostel|dormitor|accommodat|boarding|residence\s+hall|warden", ("Hostel", "hostel", "general")),
    Rule(r"library|transport|shuttle|sports\s+complex|cafeteria|canteen|laboratory\s+facilit",
         ("Facilities", "facilities", "general")),
    Rule(r"fee|tuition|charges?|payment|dues|cost\s+of|prospectus", ("Finance", "finance", "academic")),
    Rule(r"admiss|apply|application|enroll|eligib|selection\s+criteria|merit\s+list",
         ("Admissions", "admissions", "admissions")),
    Rule(r"disciplin|conduct|rule|regulat|violation|penalty|sanction|code\s+of", ("Policy", "policies", "policy")),
    Rule(r"attendance|absent|leave|punctual|late|tardy", ("Academic", "academic", "academic")),
    Rule(r"\bexam(ination)?s?\b|re-?checking|re-?evaluation|answer\s+sheet|invigilat|question\s+paper|result|grade|"
         r"cgpa|gpa", ("Examination", "examination", "academic")),
    Rule(r"credit\s+hour|course|semester|degree|program|syllabus|timetable", ("Academic", "academic", "academic")),
    Rule(r"faculty|professor|lecturer|instructor|staff|teacher|dean|rector|director",
         ("Faculty", "faculty", "faculty")),
    Rule(r"event|seminar|workshop|conference|ceremony|webinar|convocation", ("Events", "events", "event")),
    Rule(r"notice|announcement|circular|bulletin|news\s+letter", ("Notices", "notices", "notice")),
    Rule(r"contact|phone|email|address|location|helpline", ("Contact", "contact", "contact")),
    Rule(r"\b(cs|cse|it|bscs|bsit|bsse|software\s+eng|computer\s+science)\b", ("CS & IT", "dept-cs", "department")),
    Rule(r"\b(bba|mba|business\s+admin|management|commerce)\b", ("BBA", "dept-bba", "department")),
    Rule(r"pharm(acy|acology|d)|d\.pharm", ("Pharmacy", "dept-pharmacy", "department")),
    Rule(r"nurs(ing|e)|midwifery", ("Nursing", "dept-nursing", "department")),
)
CHUNK_DEFAULT = ("General", "general", "general")

# Category to namespace.
NAMESPACE_RULES = (
    Rule(r"facult|staff|professor|lecturer|instructor|dean|rector|director", ("faculty",)),
    Rule(r"admiss|apply|enroll|eligib", ("admissions",)),
    Rule(r"scholarship|financial.?aid|merit|bursary", ("scholarships",)),
    Rule(r"fee|tuition|cost|charges?|finance|dues", ("finance",)),
    Rule(r"notice|announcement|news|circular|bulletin", ("notices",)),
    Rule(r"event|seminar|workshop|conference|ceremony|webinar", ("events",)),
    Rule(r"policy|rule|regulation|handbook|code.?of.?conduct", ("policies",)),
    Rule(r"contact|location|address|phone|email", ("contact",)),
    Rule(r"hostel|dormitor|accommodat|boarding|residence.?hall", ("hostel",)),
    Rule(r"exam|examination|result|grade|cgpa|gpa", ("examination",)),
    Rule(r"facility|facilities|transport|library|sports|cafeteria|lab", ("facilities",)),
    Rule(r"cs|cse|it|software|computer.?science|bscs|bsit|bsse", ("dept-cs",)),
    Rule(r"bba|mba|business|management|commerce", ("dept-bba",)),
    Rule(r"pharm", ("dept-pharmacy",)),
    Rule(r"nurs", ("dept-nursing",)),
    Rule(r"academic|curriculum|course|syllabus|semester|program|degree", ("academic",)),
    Rule(r"alumni|graduate|former", ("alumni",)),
)

# Namespaces known before any entry is stored.
STATIC_NAMESPACES = ("finance", "scholarships", "academic", "examination", "hostel", "facilities", "admissions",
                     "policies", "faculty", "events", "notices", "contact", "dept-cs", "dept-bba", "dept-pharmacy",
                     "dept-nursing", "general")


class TypeBoost(NamedTuple):
    pattern: str
    page_types: tuple[str, ...]
    weight: float


# Query pattern, page types it favours, weight.
TYPE_BOOSTS = (
    TypeBoost(r"notice|announce|circular|latest|new|update|today|recent", ("notice", "event"), 0.25),
    TypeBoost(r"admiss|apply|enroll|join|eligib|require|how to apply|entry test", ("admissions",), 0.25),
    TypeBoost(r"alumni|graduate|former|success|career after", ("alumni",), 0.2),
    TypeBoost(r"scholarship|financial.?aid|merit|bursary|waiver", ("scholarship",), 0.25),
    TypeBoost(r"faculty|professor|staff|teacher|lecturer|dr\.|prof\.|hod|head of department", ("faculty",), 0.25),
    TypeBoost(r"policy|rule|regulation|handbook|code", ("policy",), 0.2),
    TypeBoost(r"fee|tuition|cost|charges?|dues|payment|installment", ("academic",), 0.25),
    TypeBoost(r"contact|phone|email|location|address|office|reach", ("contact",), 0.2),
    TypeBoost(r"exam|examination|grading|gpa|marks|result|grade", ("examination", "academic"), 0.3),
    TypeBoost(r"student.?handbook|slc|student life|campus life|hostel|disciplin", ("student-handbook", "policy"), 0.3),
)

# Elements, classes, ids and roles that hold no page content.
BOILERPLATE_TAGS = ("script", "style", "noscript", "iframe", "object", "embed", "nav", "header", "footer", "aside")
BOILERPLATE_CLASSES = (
    "nav", "navbar", "navigation", "menu", "header", "footer", "sidebar", "cookie-banner", "cookie-notice", "popup", "modal",
    "overlay", "social-share", "social-links", "share-buttons", "breadcrumb-nav", "pagination", "pager", "wp-caption", "gallery",
    "related-posts", "post-navigation", "site-header", "site-footer", "topbar", "bottom-bar", "main-nav", "footer-bottom",
    "scroll-top", "back-to-top", "floating-btn",
)
BOILERPLATE_IDS = (
    "topnav", "nav", "header", "footer", "sidebar", "menu", "topbar", "top-bar", "bottom-bar",
)
BOILERPLATE_ROLES = ("navigation", "banner", "contentinfo", "complementary")
SOCIAL_LINK_PATTERN = r"(?i)facebook|twitter|youtube|linkedin|instagram|whatsapp"
SOCIAL_HOLDERS = ("div", "ul", "li")
# Where the content of a page is looked for, in this order (tag, role, id or class).
CONTENT_CONTAINERS = ("main", "article", "role=main", "#content", "#main-content", "#page-content", ".content",
                      ".main-content", ".entry-content", ".post-content", ".page-content", ".article-content",
                      ".department-content", ".about-content", "#main")
BLOCK_TAGS = ("h1", "h2", "h3", "h4", "p", "li", "td", "th", "dt", "dd", "blockquote")
PROFILE_HEADING_PATTERN = (r"(?i)qualification|education|experience|research|publication|specialization|interest|"
                           r"achievement")

# How a personal page is read.  Field: lines with its label, pattern of the value, group of the pattern.
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "strong", "b")
NAME_SELECTORS = ("h4", ".profile-name", ".name")
PROFILE_FIELDS = {
    "email": ("@", r"[\w.-]+@[\w.-]+\.[a-zA-Z]{2,}", 0),
    "phone": ("(?i)phone|cell|contact", r"[\d+-]{7,}", 0),
    "designation": ("(?i)designation|lecturer|professor|assistant|associate|instructor", r"(?is)^(?:.*?designation:?)?(.*)$", 1),
    "department": ("(?i)department|faculty of|dept", r"(?is)^(?:.*?(?:department|dept):?)?(.*)$", 1),
}
PROFILE_LINES = (("Designation", "designation"), ("Department", "department"), ("Email", "email"), ("Phone", "phone"))
PROFILE_TITLE_NOISE = "(?i)profile|[-|:]"
PROFILE_NO_NAME = "Faculty Member"
