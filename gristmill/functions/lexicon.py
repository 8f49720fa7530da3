"""Word lists and numbers that define the semantics. Fixed values."""

# Abbreviations whose stop does not end a sentence.
ABBREVIATIONS = ("etc.", "vs.", "inc.", "ltd.", "co.", "corp.", "sr.", "jr.", "dr.", "mr.", "ms.", "mrs.", "no.", "approx.", "incl.", "dept.", "st.")

# Words that neither begin nor end a candidate.
STOPWORDS = tuple(
    """a an the and or nor but of in on at to for with without by from as into onto over under within across via per than
    is are be been being was were has have having do does our your their its you we they it this that these those who which
    what where when how will can should must may not no such like including e.g i.e etc also other any all both either more
    most very least some""".split()
)

# Words that carry no requirement of their own.
GENERIC = tuple(
    """experience experiences skill skills ability abilities knowledge background expertise familiarity proficiency
    understanding bonus plus points requirement requirements qualifications hands-on strong solid deep proven demonstrated
    excellent good great working professional relevant related similar equivalent track record comfort passion interest year
    years month months field foreign""".split()
)

# Words that part a sentence into chunks; "such" only before "as".
SEPARATORS = ("and", "or", "nor", "&", "+", "plus", "with", "including", "like", "e.g", "i.e", "especially", "preferably", "ideally", "such")

# One-word labels that are never skills.
LABELS = ("bonus", "plus", "preferred", "required", "requirement", "requirements", "note", "ideally")

# Words that mark a job title.
ROLE_WORDS = ("engineer", "engineers", "developer", "developers", "architect", "manager", "lead", "scientist", "analyst", "administrator", "designer", "sre")

# Stop words of label matching, and suffixes in the order in which they are tried.
MATCH_STOPWORDS = ("a", "an", "the", "and", "or", "of", "in", "on", "at", "to", "for", "with", "by", "from", "as", "is", "are", "be", "experience", "strong", "proficiency", "knowledge")
SUFFIXES = ("izations", "ization", "ments", "ment", "ships", "ship", "ings", "ing", "ions", "ion", "es", "ed", "s")

# Resume sections by heading keyword, in order.
RESUME_SECTIONS = (
    ("projects", ("project",)),
    ("education", ("education",)),
    ("certifications", ("certif", "licens")),
    ("skills", ("skill", "technolog", "tech stack", "tools")),
    ("summary", ("summary", "profile", "about", "objective")),
    ("experience", ("experience", "employment", "work history", "career")),
)

# Weights and limits.
MATCH_WEIGHTS = (80.7, 18.5, -55.2)
CREDIT = {"strong": 1.0, "partial": 0.6, "weak": 0.3, "none": 0.0}
TIER_WEIGHT = {"required": 3.0, "preferred": 1.5, "mentioned": 1.0}
MAX_WINDOW, MAX_CHUNK_WORDS, MAX_OPTIONS = 4, 8, 250
REQUIREMENT_MASS, KEEP_MASS, LINK_MASS = 0.7, 0.5, 0.7
RETRIEVE_K, RETRIEVE_FLOOR, NARROW = 8, 0.01, 16
SECTION_BATCH, VALIDATION_BATCH, REFINEMENT_BYTES = 60, 150, 80_000
TRIGRAM_SIMILAR, ALL_PAIRS = 0.35, 40
SUMMARY_RUNES, FALLBACK_RUNES = 600, 1500
TEXT_BYTES = 48 * 1024
SKILL_ITEMS = 6

# Strings that look like keys, and the bytes of a provider's message that are kept.
SECRET_LIKE = "(?i)(bearer\\s+\\S+|\\bsk-[a-z0-9_\\-]{8,}|\\b[a-z0-9_\\-]{32,}\\b)"
MESSAGE_BYTES = 512

# Glyphs of list items in PDF text, and lines that are headings of a resume.
BULLETS = "•●◦▪■‣"
PDF_HEADINGS = (
    "summary", "professional summary", "profile", "professional profile", "about", "about me", "objective", "career objective", "experience", "work experience", "professional experience",
    "employment", "employment history", "work history", "career history", "skills", "technical skills", "core skills", "key skills", "technologies", "tech stack", "tools", "skills & tools",
    "education", "certifications", "certificates", "licenses & certifications", "education & certifications", "projects", "personal projects", "side projects", "selected projects",
    "awards", "publications", "languages", "volunteering", "interests",
)
PDF_BYTES, PDF_PAGES, PDF_DEPTH, PDF_NODES, RESULT_BYTES = 10 << 20, 20, 32, 1000, 4 << 20
