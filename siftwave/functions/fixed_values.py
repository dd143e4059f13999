"""Fixed values.

Word lists, code lists, thresholds and patterns that decide the results. They
are data, not logic: every operator takes them from here. Patterns are written
for ``java.util.regex``; ``(?U)`` makes ``\\w \\d \\s \\b`` follow Unicode and
``(?iuU)`` also ignores case. Look-behinds stand after a cheap look-ahead, so a
position that cannot start a match is left at once.
"""

# --- fixed values: labels, channels, enumerations ---------------------------------
LABELS = ["normal", "spam", "scam"]
SCAM_TYPES = [
    "bank_impersonation", "authority_impersonation", "job_scam", "prize_scam", "investment_scam",
    "loan_scam", "delivery_scam", "relative_impersonation", "account_takeover", "other",
]
CHANNELS = ["sms", "zalo", "messenger", "telegram", "email", "other"]
REPORT_CHANNELS = ["api", "telegram", "extension"]
MESSAGE_SOURCES = ["collected", "public_post", "contributed", "synthetic"]
ORIGINS = ["news", "forum", "public_dataset", "manual", "synthetic"]
CONFIDENCE_LEVELS = ["high", "medium", "low"]
INTEL_KINDS = ["rss", "html_list", "domain_list", "domain_page", "manual"]
TRAINING_KINDS = ["rss", "html_list", "csv_dataset", "manual"]
PLACEHOLDERS = ["<PHONE>", "<ACCOUNT>", "<NAME>", "<EMAIL>", "<URL>", "<ID>", "<OTP>"]
PII_KINDS = ["email", "url", "otp", "id", "phone", "account"]

# --- fixed values: limits and thresholds ------------------------------------------
MAX_MESSAGE_LENGTH = 2000
MIN_TEXT_LENGTH = 5
MAX_LINKS_PER_REQUEST = 50
MAX_LINK_LENGTH = 500
SCAM_THRESHOLD = 0.7
THRESHOLD_TOLERANCE = 1e-9
BLOCKLISTED_CONFIDENCE = 0.99
MIN_TEMPLATE_COVERAGE = 0.6
NEAR_DUPLICATE_JACCARD = 0.8
SHINGLE_SIZE = 3
FINGERPRINT_HEX = 12
KEY_HEX = 16
MIN_TEMPLATE_TOKENS = 8
MAX_TEMPLATE_CHARS = 600
MAX_EVIDENCE_CHARS = 240
MIN_PARAGRAPH_CHARS = 20
PAGE_BLOCK_CHARS = (20, 2000)
MIN_LABEL_SHARE = 0.15
MAX_SYNTHETIC_SHARE = 0.20
TEST_SHARE = 0.15
VAL_SHARE = 0.15 / 0.85
MAX_DOMAIN_LENGTH = 253
REPORT_LIMITS = (1, 100, 500)  # smallest, default, largest
MIN_REASON_CHARS = 10
MIN_NOTE_CHARS = 5
MAX_NEW_CANDIDATES = 300
INTEL_MAX_ITEMS = 15
TRAINING_MAX_ITEMS = 10
REQUESTS_PER_WINDOW = 30
MIN_LLM_CONFIDENCE = 0.5
BRAND_SUBSTRING_LENGTH = 5
BRAND_TYPO_LENGTH = 8

# --- fixed values: reason codes, weights, descriptions ----------------------------
REASON_WEIGHTS = {
    "url_brand_impersonation": 0.6,
    "url_obfuscated": 0.4,
    "url_ip_address_host": 0.4,
    "url_punycode": 0.4,
    "url_suspicious_tld": 0.3,
    "url_shortener": 0.15,
}
REASON_DESCRIPTIONS = {
    "model_predicted_scam": "Nội dung giống các tin lừa đảo đã biết",
    "model_predicted_spam": "Nội dung giống tin quảng cáo hàng loạt",
    "scam_probability_below_threshold": "Có vài dấu hiệu lừa đảo nhưng chưa đủ chắc chắn",
    "url_shortener": "Có link rút gọn, che giấu trang đích",
    "url_ip_address_host": "Link dùng địa chỉ IP thay vì tên miền",
    "url_punycode": "Tên miền dùng ký tự giả mạo (punycode)",
    "url_suspicious_tld": "Tên miền có đuôi thường bị dùng để lừa đảo",
    "url_obfuscated": "Link bị viết lách (như [.] hay hxxp) để né bộ lọc",
    "url_brand_impersonation": "Tên miền giả danh ngân hàng, ví điện tử hoặc cơ quan nhà nước",
    "url_blocklisted": "Link nằm trong danh sách tên miền lừa đảo đã được cảnh báo",
    "matches_known_scam_template": "Nội dung trùng với mẫu tin lừa đảo đã được cảnh báo",
}

# --- fixed values: hosts and domain endings ---------------------------------------
SHORTENER_HOSTS = [
    "bit.ly", "tinyurl.com", "t.ly", "cutt.ly", "rb.gy", "is.gd", "s.id",
    "shorturl.at", "goo.gl", "ow.ly", "tiny.cc", "t.co", "rebrand.ly",
]
SUSPICIOUS_TLDS = [
    "xyz", "top", "club", "icu", "online", "site", "vip", "shop", "live",
    "buzz", "cc", "tk", "ml", "ga", "cf", "gq",
]
URL_TLDS = (
    "com|vn|net|org|info|xyz|top|me|ly|io|cc|online|site|shop|link|club|icu|vip|live|buzz|"
    "tk|ml|ga|cf|gq|gl|gd|id|at|gy"
)
DOMAIN_TLDS = [
    "com", "net", "org", "info", "biz", "vn", "xyz", "top", "me", "ly", "io", "cc", "online", "site", "shop",
    "link", "club", "icu", "vip", "live", "buzz", "tk", "ml", "ga", "cf", "gq", "gl", "gd", "id", "at", "gy",
    "co", "app", "dev", "cn", "ru", "uk", "us", "asia", "pro", "store", "tech", "fun", "space", "website",
    "win", "bid", "loan", "work", "click", "cyou", "sbs", "cfd", "bond", "lol", "mobi", "tv", "in", "ph",
    "th", "sg", "my", "kr", "jp", "hk", "tw", "au", "nz", "de", "fr", "nl", "eu", "ca", "be", "ch", "es",
    "it", "pl", "br", "mx", "cloud", "today", "world", "news", "life", "one", "host", "press", "agency",
    "finance", "money", "bet", "casino", "games", "email", "digital", "network", "center", "group",
    "company", "services", "solutions", "support", "help", "global", "social", "kim", "ink", "pw", "su",
    "lat", "rest", "monster", "beauty", "homes", "autos", "quest", "best", "xin", "wang", "ltd", "vin",
    "mom", "pics", "zone", "tokyo", "cam", "fit", "run", "red", "blue", "pink", "gold", "plus", "team",
    "trade", "market", "exchange", "investments", "capital", "fund", "cash", "credit", "bank",
]
SHARED_PLATFORM_ROOTS = [
    "blogspot.com", "wordpress.com", "github.io", "gitlab.io", "web.app", "firebaseapp.com",
    "vercel.app", "netlify.app", "pages.dev", "workers.dev", "herokuapp.com", "glitch.me",
    "weebly.com", "wixsite.com", "000webhostapp.com", "sites.google.com", "forms.gle", "linktr.ee",
    "ngrok.io", "ngrok-free.app", "azurewebsites.net", "cloudfront.net", "amazonaws.com",
    "web.core.windows.net", "notion.site",
]
PUBLIC_SUFFIXES = [
    "vn", "com", "net", "org", "com.vn", "net.vn", "org.vn", "edu.vn", "gov.vn", "info.vn", "biz.vn",
]
REDIRECT_HOSTS = ["l.facebook.com", "lm.facebook.com", "l.messenger.com"]
BRAND_KEYWORDS = [
    "vietcombank", "vcb", "techcombank", "vietinbank", "agribank", "bidv", "sacombank", "vpbank", "mbbank",
    "tpbank", "hdbank", "seabank", "eximbank", "lpbank", "pvcombank", "namabank", "abbank", "bacabank",
    "kienlongbank", "baovietbank", "saigonbank", "vietabank", "acb", "ocb", "msb", "shb", "vib", "napas",
    "momo", "zalopay", "vnpay", "shopeepay", "viettelmoney", "shopee", "lazada", "tiktok", "sendo",
    "viettelpost", "vnpost", "ghtk", "jtexpress", "bocongan", "bca", "dichvucong", "dvc", "vneid",
    "chinhphu", "evn", "vtp", "viettel", "vinaphone", "mobifone", "vnpt", "facebook", "zalo", "telegram",
    "messenger",
]
AI_TRAINING_AGENTS = [
    "gptbot", "ccbot", "claudebot", "anthropic-ai", "google-extended", "applebot-extended",
    "bytespider", "meta-externalagent",
]
WARNING_KEYWORDS = ["lừa đảo", "giả danh", "mạo danh", "chiếm đoạt", "giả mạo", "cảnh báo", "lừa"]
JSON_DOMAIN_KEYS = ["domain", "url", "website", "link"]

# --- fixed values: HTML element names ---------------------------------------------
CONTENT_TAGS = ["p", "blockquote", "li", "h1", "h2", "h3", "figcaption", "td"]
SKIPPED_TAGS = ["script", "style", "nav", "footer", "aside", "header", "form", "noscript", "svg"]
CLASS_SKIPPED_TAGS = ["script", "style", "noscript", "svg"]
VOID_TAGS = ["br", "img", "hr", "input", "meta", "link", "source", "wbr"]
BLOCK_TAGS = ["p", "div", "li", "blockquote", "tr"]

# --- fixed values: patterns -------------------------------------------------------
URL_USER_PART = r"(?i)^((?:[a-z][a-z0-9+.-]*://)?)[^/@\s]*@"
URL_QUERY_AND_FRAGMENT = r"[?#].*$"
URL_TAIL_PUNCTUATION = "[.,;:!?)\\]}\"']"
INVISIBLE = "[\\u00ad\\u200b-\\u200d\\u2060\\ufeff]"
BRACKETED_DOT = (
    r"(?iuU)(?<=[a-z0-9])\s?(?:\[\s?(?:\.|dot|ch[ấa]m)\s?\]|\(\s?(?:\.|dot|ch[ấa]m)\s?\)"
    r"|\{\s?(?:\.|dot|ch[ấa]m)\s?\})\s?(?=[a-z0-9])"
)
DEFANGED_SCHEME = r"(?iuU)\bh(?:xx|\*\*)p(s?)(?:\[:\]|:)//"
DEFANGED_DOT = r"(?iu)\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)"
DEFANGED_HXXP = r"(?iuU)\bhxxps?"
DEFANGED_COLON = r"\[:\]"
URL = (
    r"(?iuU)(?:https?://|www\.)[^\s<>\"]+|\b(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+"
    rf"(?-i:(?:{URL_TLDS})|(?:{URL_TLDS.upper()}))\b(?:/[^\s<>\"]*)?"
)
SCHEME_URL = r"(?iu)(?:https?://|www\.)[^\s<>\"]+"
BARE_DOMAIN = r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}\b(?:/[^\s<>\"]*)?"
EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
OTP = (
    r"(?iuU)(?=\d)(?<![\d.,/])(?<=(?:otp|m[ãa] (?:x[áa]c (?:nh[ậa]n|th[ựu]c|minh)|b[ảa]o m[ậa]t|giao d[ịi]ch|k[íi]ch ho[ạa]t)"
    r"|nh[ậa]p m[ãa])[^\d<>]{0,20})\d(?:[ .\-]?\d){3,7}(?![\d.,/]?\d)"
)
ID_NUMBER = (
    r"(?iuU)(?=\d)(?<![\d.,/])(?<=(?:cccd|cmnd|c[ăa]n c[ưu][ớo]c|ch[ứu]ng minh|đ[ịi]nh danh|dinh danh)[^\d<>]{0,25})"
    r"(?:\d{12}|\d{9}|\d{3}(?:[ .\-]\d{3}){2,3}|\d{4}(?:[ .\-]\d{4}){2})(?![\d.,/]?\d)"
)
PHONE = (
    r"(?U)(?=[(+\d])(?<![\d.,/])(?:(?:\(\+?84\)|\+?84|0)[ .\-]?(?:\d{9,10}|\d{2,4}(?:[ .\-]\d{3,4}){2,3}"
    r"|\d(?:[ .\-]\d{2}){4})|\(0\d{1,3}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4})(?![\d.,/]?\d)"
)
ACCOUNT = (
    r"(?iuU)(?<!\d)\d{4}(?:[ .\-]\d{4}){2,3}(?:[ .\-]\d{1,3})?(?!\d)"
    r"|(?<!\d)\d{9,19}(?!\d)(?!\s?(?:đồng|dong|vnđ|vnd|đ|d)(?![^\W\d_]))"
)
TOKEN = r"(?U)(<[A-Z]+>|[^\W_]+)"
UNKNOWN_PLACEHOLDER = r"(<[A-Z_]+>)"
HONORIFIC = (
    r"(?iuU)\b(?:anh|chị|chi|em|ông|ong|bà|cô|chú|chu|bác|bac|bạn|ban|mr|mrs|ms)\.?\s+([^\W\d_]+)"
)
DOMAIN = (
    r"(?iu)(?:https?://)?(?:www\.)?((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24})(?![a-z0-9-])"
)
QUOTE = "[“\"«]([^”\"»]{30,600})[”\"»]"
VIETNAMESE_LETTER = (
    "(?iu)[ăâđêôơưàảãạáằẳẵặắầẩẫậấèẻẽẹéềểễệếìỉĩịíòỏõọóồổỗộốờởỡợớùủũụúừửữựứỳỷỹỵý]"
)
WARNING_CONTEXT = (
    r"(?iuU)gi[ảa] m[ạa]o|l[ừu]a [đd][ảa]o|m[ạa]o danh|gi[ảa] danh|trang (?:web|website|m[ạa]ng)|"
    r"[đd][ưu][ờo]ng (?:link|d[ẫa]n)|t[êe]n mi[ềe]n|website|truy c[ậa]p"
)
SCAM_SIGNAL = (
    r"(?iuU)chuy[ểe]n (?:ti[ềe]n|kho[ảa]n)|\botp\b|m[ãa] x[áa]c|t[àa]i kho[ảa]n|tr[úu]ng th[ưu][ởo]ng|qu[àa] t[ặa]ng|"
    r"<URL>|<PHONE>|<ACCOUNT>|<OTP>|nh[ấa]n (?:v[àa]o|link)|truy c[ậa]p|x[áa]c (?:minh|th[ựu]c)|kh[óo]a|ph[ạa]t|"
    r"vi[ệe]c nh[ẹe]|c[ộo]ng t[áa]c vi[êe]n|nhi[ệe]m v[ụu]|vay|gi[ảa]i ng[âa]n|ph[íi]|n[ạa]p"
)
CALL_TO_ACTION = (
    r"(?iuU)\b(?:b[ạa]n|qu[ýy] kh[áa]ch|anh|ch[ịi]|em|vui l[òo]ng|h[ãa]y|nh[ấa]n|b[ấa]m|click|truy c[ậa]p|chuy[ểe]n|n[ạa]p|"
    r"cung c[ấa]p|[đd][ọo]c|g[ửu]i|li[êe]n h[ệe]|[đd][ăa]ng (?:k[ýy]|nh[ậa]p)|nh[ậa]n|x[áa]c (?:minh|nh[ậa]n|th[ựu]c)|"
    r"tham gia|k[ếe]t b[ạa]n|t[ảa]i|c[àa]i)\b"
)
ADVICE_OR_NARRATION = (
    r"(?iuU)^(?:ng[ưu][ờo]i d[âa]n|m[ọo]i ng[ưu][ờo]i|c[ôo]ng an|ng[âa]n h[àa]ng khuy[ếe]n c[áa]o|"
    r"t[ôo]i (?:đ[ãa]|r[ấa]t|c[ũu]ng)|nhi[ềe]u ng[ưu][ờo]i)"
    r"|khuy[ếe]n c[áa]o|tuy[ệe]t [đd][ốo]i kh[ôo]ng (?:truy c[ậa]p|cung c[ấa]p|chuy[ểe]n)|kh[ôo]ng n[êe]n|"
    r"\bcho bi[ếe]t\b|\bk[ểe] l[ạa]i\b|b[ịi] (?:l[ừu]a|chi[ếe]m [đd]o[ạa]t)"
)
REPORTER_LANGUAGE = (
    r"(?iuU)c[áa]c [đd][ốo]i t[ưu][ợo]ng|[đd][ấa]u tranh|tri[ệe]t [đd][ểe]|b[ịi] (?:can|c[áa]o)|n[ạa]n nh[âa]n|"
    r"th[ủu] [đd]o[ạa]n|ph[ưu][ơo]ng th[ứu]c|chi[êe]u tr[òo]|[đd][ưu][ờo]ng d[âa]y"
)
MESSAGE_ID = r"^msg_\d{6}$"
TEMPLATE_ID = r"^tpl_\d{6}$"
CONTENT_SIGNAL = r"(?im)^\s*content-signal\s*:\s*(.+)$"
ROBOTS_DIRECTIVE = r"(?iU)^\s*(user-agent|disallow|allow)\s*:\s*(.*?)\s*(?:#.*)?$"
