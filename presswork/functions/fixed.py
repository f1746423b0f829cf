"""Word lists, patterns, limits and maps that results depend on."""

# Limits ----------------------------------------------------------------------------------
DOC_CHARS = (800, 60_000)
BLOCK_MIN_CHARS, BLOCKS_PER_DOC = 30, 400
SENTENCE_CHARS, SENTENCES_PER_BLOCK = (15, 800), 80
TOP_DOMAINS = 40
TOPIC_BLOCK_CHARS = (80, 5_000)
NER_CHARS = 4_000
MENTION_CONFIDENCE, NAME_CHARS = 0.45, (2, 120)
CANDIDATE_MIN_DOCS, CANDIDATE_MIN_ROWS, CANDIDATES = 3, 5, 15_000
CONTEXTS_PER_ENTITY, CONTEXT_CHARS = 8, 1_400
HEAD_DOCS, MID_DOCS, TAIL_DOCS = 300, 80, 20
TIER_SHARES = {"head": 0.45, "mid": 0.35, "tail": 0.20}
TYPE_TARGETS = {"company": 3200, "technology": 3200, "government_institution": 1400, "person": 1200}
PER_ENTITY = {
    "head": {"company": 18, "technology": 18, "government_institution": 10, "person": 8},
    "mid": {"company": 10, "technology": 10, "government_institution": 6, "person": 5},
    "tail": {"company": 5, "technology": 5, "government_institution": 4, "person": 4},
}
VALID_SHARE, GROUP_VALID_SHARE, VALID_ROWS = 0.15, 0.18, 1200
HARD_CASES = 1000
CANDIDATES_FIRST = 18_000

# Patterns; word edges are written out so that every engine reads them alike ---------------
KEYWORDS = (
    "ai", "artificial intelligence", "machine learning", "deep learning", "generative ai", "genai",
    "large language model", "llm", "foundation model", "chatgpt", "openai", "anthropic", "gemini", "copilot",
    "computer vision", "speech recognition", "robotics",
)
MENU_TERMS = (
    "sign up", "subscribe", "newsletter", "privacy", "cookie", "terms", "advertisement", "advertiser", "share on",
    "share this", "follow us", "read more", "continue reading", "open menu", "close menu", "main menu", "navigation",
    "skip to main content", "all rights reserved", "contact us", "login", "log in", "register", "recommended",
    "related stories", "distribution channels", "published", "updated", "copyright", "press release", "business wire",
    "pr newswire", "menu", "search",
)
SOCIAL_TERMS = ("facebook", "twitter", "linkedin", "reddit", "discord", "youtube", "instagram", "whatsapp")
URL_MARKS = r"(https?://|www\.|\.(com|org|net)([^A-Za-z0-9_]|$))"
SCRIPT_MARKS = r"(?i)(function\s*\(|window\.|document\.|onclick|IntersectionObserver|var\s+[A-Za-z0-9_]+\s*=)"
OUTER_PUNCT = " \t\r\n-–—:;,.'\"“”‘’()[]{}<>|/"
#: What counts as white space, no-break and wide kinds included.
SPACE_JAVA = r"[\s\x0b\x1c-\x1f\u0085   -     　]+"
SPACE_RE2 = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# Patterns of names that are numbers, prices, catalogue entries, fragments or variants
NUMBER_NAMES = (
    r"^[#$€£¥]?\d[\d,.\-+%/ ]*$", r"^[#$€£¥]?[A-Z]*\d+[A-Z0-9\-+./% ]*$", r"(?i)^(#|No\.?|Booth|Stand)\s*[A-Z0-9.\-]+$",
    r"^[$€£¥]\s*\d[\d,.\-+% ]*$",
)
PRICE_NAMES = (
    r"^[#$€£¥]?\d[\d,.\-+%/ ]*$", r"^[$€£¥]\s*\d[\d,.\-+% ]*$", r"^[#$€£¥]?[A-Z]*\d+[A-Z0-9\-+./% ]*$", r"^[$€£¥#]",
)
CATALOG_NAMES = (r"^[#$]", r"[0-9]{4,}")
NUMBERED_PLACE = r"^#?\d[\w.\-+]*$"
SINGLE_NAME = "^[A-Z][a-z]+$"
MODEL_FAMILY = r"^0?\d+ (family|model|models|reasoning model)$"
HIDDEN_NAMES = (r"^\s*[#$+]", r"^\s*[0-9]{2}[A-Za-z]{2}", "[0-9]{4,}")
HIDDEN_WORDS = ("booth", "token", "presale", "market", "startup", "fintech", "valued company")
ENTITY_PUNCT = r"[()\[\]{}.,;:!?\"“”‘’/\\|]+"
SURFACE_EDGES = (r"^[+*|~]+", r"^[.:;,_\- ]+", r"[.:;,_\- ]+$", r"^\d{2}([A-Z][a-z])", r"^\+\s*")

# Entity vocabularies -----------------------------------------------------------------------
GENERIC_ACTORS = (
    "he", "she", "they", "we", "i", "you", "users", "researchers", "scientists", "developers", "engineers", "students",
    "workers", "people", "consumers", "customers", "patients", "teachers", "parents", "children", "officials",
    "executives", "lawmakers", "analysts", "experts", "critics", "authors", "journalists", "publishers", "creators",
    "employees", "employers", "founders", "investors",
)
GENERIC_PLACES = ("world", "europe", "asia", "africa", "america", "americas", "global", "international")
GENERIC_TECHNOLOGY = (
    "ai", "artificial intelligence", "machine learning", "deep learning", "generative ai", "large language model",
    "large language models", "llm", "llms", "chatbot", "chatbots", "ai model", "ai models", "ai tool", "ai tools",
    "ai system", "ai systems", "ai technology", "ai technologies",
)
LOW_VALUE_TECHNOLOGY = ("ai", "artificial intelligence", "ai models", "ai systems", "ai tools", "ai technology")
NEWS_SOURCES = (
    "abc news", "afp", "agence france-presse", "al jazeera", "ap", "ars technica", "associated press", "axios", "bbc",
    "bbc news", "bloomberg", "boston globe", "business insider", "business wire", "buzzfeed", "cbs news",
    "chicago tribune", "cnbc", "cnet", "cnn", "daily mail", "deutsche welle", "dw", "economist", "financial times",
    "forbes", "fox news", "fortune", "guardian", "huffpost", "independent", "insider", "marketwatch", "msnbc",
    "nbc news", "new york post", "new york times", "newsweek", "npr", "politico", "pr newswire", "prnewswire",
    "reuters", "sky news", "techcrunch", "the associated press", "the atlantic", "the economist", "the guardian",
    "the information", "the intercept", "the new york times", "the wall street journal", "the washington post", "time",
    "usa today", "vice", "vox", "wall street journal", "washington post", "wired", "wsj", "xinhua", "yahoo finance",
    "yahoo news", "zdnet",
)
TYPE_NAMES = {
    "government institution": "government_institution", "government_institution": "government_institution",
    "location": "government_institution", "person": "person", "company": "company", "technology": "technology",
    "organization": "organization", "product": "product", "other": "other",
}
TYPE_PRIORITY = {"company": 6, "technology": 5, "government_institution": 4, "person": 3, "product": 2, "organization": 1, "other": 0}
TYPE_HINTS = {
    "openai": "company", "google": "company", "microsoft": "company", "amazon": "company", "apple": "company",
    "nvidia": "company", "meta": "company", "anthropic": "company", "alphabet": "company", "tesla": "company",
    "chatgpt": "technology", "gpt-4": "technology", "gpt-4o": "technology", "claude": "technology",
    "gemini": "technology", "copilot": "technology", "ai": "technology", "artificial intelligence": "technology",
    "generative ai": "technology", "machine learning": "technology", "large language model": "technology",
    "large language models": "technology", "united states": "government_institution",
    "china": "government_institution", "india": "government_institution", "united kingdom": "government_institution",
    "european union": "government_institution", "california": "government_institution",
    "new york": "government_institution", "san francisco": "government_institution",
}
SAFE_NAMES = {
    "open ai": "OpenAI", "chat gpt": "ChatGPT", "gpt 4": "GPT-4", "gpt4": "GPT-4", "gpt 4o": "GPT-4o",
    "gpt4o": "GPT-4o", "nvidia": "Nvidia", "u s": "United States", "u s a": "United States", "usa": "United States",
    "u k": "United Kingdom", "uk": "United Kingdom", "eu": "European Union", "a i": "AI", "ai": "AI",
    "a i models": "AI models", "a i systems": "AI systems", "a i tools": "AI tools",
    "a i technology": "AI technology", "a i technologies": "AI technologies",
}
SURFACE_NAMES = {
    "open ai": "OpenAI", "chat gpt": "ChatGPT", "gpt 4": "GPT-4", "gpt4": "GPT-4", "gpt 4o": "GPT-4o",
    "gpt4o": "GPT-4o", "u s": "United States", "u s a": "United States", "usa": "United States",
    "u k": "United Kingdom", "uk": "United Kingdom", "eu": "European Union", "a i": "AI", "ai": "AI",
    "llms": "LLMs", "llm": "LLM", "0g labs": "0G Labs", "0g foundation": "0G Foundation", "01 ai": "01.ai",
}
ANALYSIS_TYPES = ("company", "technology", "government_institution", "person")
SENTIMENTS = ("negative", "mixed_or_unclear", "positive")
CATALOG_MARKS = (
    "booth", "stand", "hall", "suite", "presale", "token", "market", "valuation", "valued company", "startup",
    "fintech", "series [a-z]",
)
INDUSTRY_RULES = (
    ("Healthcare & life sciences", ("health", "medical", "clinical", "diagnostic", "hospital", "provider", "pharma", "life sciences", "biotech")),
    ("Enterprise software & productivity", ("enterprise", "workflow", "productivity", "copilot", "assistant", "chatbot", "crm", "coding", "developer", "software")),
    ("Media, marketing & content", ("content", "creative", "image", "video", "media", "search", "marketing", "advertis", "design", "creator")),
    ("Finance, legal & compliance", ("finance", "bank", "trading", "fintech", "insurance", "legal", "law", "compliance", "governance", "privacy", "regulat")),
    ("Education & knowledge work", ("education", "learning", "tutor", "research", "academic", "writing", "knowledge")),
    ("Semiconductors & AI infrastructure", ("gpu", "nvidia", "intel", "chip", "semiconductor", "cloud", "data center", "compute", "cpu", "infrastructure")),
    ("Customer service & operations", ("customer service", "call center", "voice", "contact center", "order", "operations", "fulfillment", "support")),
)
MECHANISMS = {
    "automation": ("automate", "automation", "replace", "autonomous"),
    "augmentation": ("augment", "assist", "copilot", "productivity"),
    "workflow_redesign": ("workflow", "process", "integrat", "embedded", "deployment", "operations"),
    "cost_reduction": ("cost", "saving", "efficien", "margin"),
    "customer_service_scaling": ("customer service", "support", "chatbot", "call center", "voice", "ordering"),
    "content_generation": ("generate", "generation", "draft", "write", "image", "video", "content"),
    "decision_support": ("recommend", "predict", "analy", "triage", "diagnos", "decision"),
    "regulation_risk": ("regulat", "compliance", "privacy", "copyright", "governance", "legal"),
}
PLACES_KEPT = (
    "united states", "us", "u s", "usa", "china", "india", "united kingdom", "uk", "european union", "eu", "california",
    "new york", "san francisco", "japan", "germany", "france", "canada", "south korea", "singapore", "taiwan",
    "white house", "us congress", "u s congress", "congress", "federal communications commission", "fcc",
    "european commission",
)
WEAK_TECHNOLOGY = (
    "ai driven search engine", "ai music generators", "ai generated robocall", "gaming algorithms",
    "algorithm black box", "human like chatbot personas", "government social scoring systems",
    "ai report writing software", "facial recognition systems", "live facial scanning",
    "0 code low code architecture", "01 family", "01 mini models", "01 model", "01 models", "01 reasoning model",
)
TOPIC_STOP = (
    "using", "used", "news", "newsletter", "subscribe", "menu", "search", "login", "register", "advertisement", "advertising",
)
ENGLISH_STOP = tuple(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do "
    "does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more "
    "most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these "
    "they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)
LABEL_ALIASES = {"pos": "positive", "1": "positive", "neg": "negative", "-1": "negative", "mixed": "mixed_or_unclear", "neutral": "mixed_or_unclear", "0": "mixed_or_unclear"}
