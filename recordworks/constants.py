"""Fixed values of the record format.

Everything in this module is a fixed value: a word list, a lookup table, a constant or a pattern that must equal the
established record format, or the same input would give other results.  There is no logic here.
"""

# ---------------------------------------------------------------------------------------------- numbers (fixed values)
# multiplier words after a number, as (pattern, factor); the first class that matches wins
MULTIPLIERS = [
    (r"crores?|cr\b", 1e7),
    (r"lakhs?|lacs?|lac\b", 1e5),
    (r"billion|bn\b|mrd\.?|milliards?|млрд\.?|mlrd", 1e9),
    (r"millions?|millones|mio\.?|mill\.?|mln\.?|mn\b|млн\.?|m\b|mm\b|juta|jt\b\.?", 1e6),
    (r"thousand|mil\b|тыс\.?|тис\.?|k\b|tsd\.?|ribu|rb\b\.?", 1e3),
]
CJK_LARGE = {"兆": 1e12, "조": 1e12, "億": 1e8, "亿": 1e8, "억": 1e8, "萬": 1e4, "万": 1e4, "만": 1e4}
CJK_SMALL = {"千": 1e3, "천": 1e3, "仟": 1e3, "百": 1e2, "백": 1e2}
# Arabic-Indic and Persian digits with the Arabic thousands and decimal marks, mapped to ASCII
ARABIC_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٬٫"
ARABIC_TO = "01234567890123456789,."

# ------------------------------------------------------------------------------------------------ money (fixed values)
# currency symbols in priority order; "?" marks a family whose member depends on the row's default currency
CURRENCY_SYMBOLS = {
    "R$": "BRL", "US$": "USD", "C$": "CAD", "A$": "AUD", "NZ$": "NZD", "HK$": "HKD", "S$": "SGD", "NT$": "TWD", "MX$": "MXN",
    "S/.": "PEN", "S/": "PEN", "zł": "PLN", "Kč": "CZK", "Ft": "HUF", "lei": "RON", "лв": "BGN", "руб": "RUB", "р.": "RUB",
    "₽": "RUB", "₸": "KZT", "тг": "KZT", "тенге": "KZT", "₾": "GEL", "лари": "GEL", "ლარი": "GEL", "₼": "AZN", "֏": "AMD", "₴": "UAH",
    "грн": "UAH", "€": "EUR", "£": "GBP", "₩": "KRW", "원": "KRW", "₹": "INR", "₺": "TRY", "₪": "ILS", "₫": "VND", "฿": "THB",
    "₱": "PHP", "₦": "NGN", "円": "JPY", "元": "CNY", "RMB": "CNY", "Rp": "IDR", "RM": "MYR", "د.إ": "AED", "ر.س": "SAR", "ج.م": "EGP",
    "сум": "UZS", "сом": "KGS", "ر.ق": "QAR", "د.ك": "KWD", "ر.ع": "OMR", "Dhs": "AED", "Dh": "AED", "$": "?", "¥": "?", "kr": "?",
    "Rs": "?", "ريال": "?", "درهم": "?", "Fr.": "CHF", "CHF": "CHF",
}
# letter symbols that are matched as written (case-sensitive, also inside words)
CASE_SENSITIVE_SYMBOLS = ["RM", "Rp", "Rs", "RMB", "CHF"]
# family symbol -> (member when the default is not one of the family, all members)
CURRENCY_FAMILIES = {
    "$": ("USD", [
        "USD", "CAD", "AUD", "NZD", "MXN", "ARS", "CLP", "COP", "UYU", "SGD", "HKD", "TWD", "BSD", "BBD", "BZD", "BMD", "FJD", "GYD",
        "JMD", "KYD", "LRD", "NAD", "SBD", "SRD", "TTD", "XCD", "BND", "DOP", "CUP",
    ]),
    "¥": ("JPY", ["JPY", "CNY"]),
    "kr": ("SEK", ["SEK", "NOK", "DKK", "ISK"]),
    "Rs": ("INR", ["INR", "PKR", "LKR", "NPR", "MUR", "SCR"]),
    "ريال": ("SAR", ["SAR", "QAR", "OMR", "YER", "IRR"]),
    "درهم": ("AED", ["AED", "MAD"]),
}
# codes accepted beside the currencies of the countries
EXTRA_CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CNY", "CHF", "BTC", "XAU"]
# area units whose letters look like a currency
NOT_MONEY = r"\bsq\.?\s*f(?:ee|oo)?t\b|\bsquare\s+f(?:ee|oo)t\b|\bft[²2]|\bpsf\b"
# keys of an offer object, in order of preference
OFFER_AMOUNT_KEYS, OFFER_CURRENCY_KEYS = ["price", "amount", "value"], ["priceCurrency", "currency"]
FREE_WORDS = r"\b(free|gratis|gratuit|kostenlos|бесплатно|無料|免费)\b"
RANGE_SPLIT = r"\s[-–—]\s|–|—|\bto\b|\bbis\b|\bdo\b|\ba\b|\bдо\b"

# ------------------------------------------------------------------------------------------------ units (fixed values)
# (unit, pattern, factor to the canonical unit); factor None: recognised but not converted; first match wins
AREA_UNITS = [
    ("sqft", r"sq\.?\s*ft|sqft|square\s*f(?:ee|oo)t|ft²|ft2|pies?\s*cuadrados", 0.09290304),
    ("sqm", r"m²|m2\b|\bqm\b|sq\.?\s*m\b|sqm|square\s*met|mts2|㎡|平米|平方米|кв\.?\s*м|м²|м2|metros?\s*cuadrados|m\.?\s*q\.?", 1.0),
    ("tsubo", r"坪|tsubo", 3.305785),
    ("pyeong", r"평|pyeong", 3.305785),
    ("hectare", r"\bha\b|hectares?|гектар|\bга\b", 10000.0),
    ("acre", r"\bacres?\b", 4046.8564224),
    ("sotka", r"сот(?:ка|ки|ок)|sotka|sotok", 100.0),
    ("perch", r"perch(?:es)?", None),
    ("marla", r"marlas?", None),
    ("kanal", r"kanals?", None),
    ("aana", r"aanas?", None),
]
DISTANCE_UNITS = [
    ("mi", r"\bmi\b|miles?|mls", 1.609344),
    ("km", r"km|кm|км|kilomet|公里|キロ|킬로", 1.0),
    ("m", r"\bm\b|meters?|metres?", 0.001),
]
WEIGHT_UNITS = [
    ("lb", r"\blbs?\b|pounds?", 0.45359237),
    ("g", r"\bg\b|grams?|gr\b|грамм|г\b", 0.001),
    ("kg", r"kg|kilo|кг|公斤|キロ", 1.0),
    ("t", r"\btons?\b|\bt\b|тонн", 1000.0),
]
UNIT_AMOUNT_SUFFIX = r"тыс\.?|thousand|k\b|万|萬"
PER_AREA = (r"\bpsf\b|\bpsm\b|per\s*(?:sq\.?\s*(?:ft|feet|m)|square\s*(?:foot|feet|met)|m²|m2|sqm|sqft)"
            r"|/\s*(?:sq\.?\s*ft|sqft|sf|m²|m2|sqm)\b|/\s*m²|€/m²|/qm\b|pro\s*m²|per\s*meter\s*persegi|/\s*kaki\s*persegi")
PER_PERSON = (r"(?:per|/|a)\s*(?:seat|desk|pax|person|head|workstation|member|orang|kerusi|meja)s?\b|\bper\s*cap"
              r"|/\s*(?:seat|desk|pax|person)\b|\bseorang\b")

# ---------------------------------------------------------------------------------------------- periods (fixed values)
PERIODS_PER_YEAR = {"hour": 2080.0, "day": 365.0, "week": 52.0, "month": 12.0, "year": 1.0}
# period -> words, separated by " | "
PERIOD_WORDS = {
    "hour": [
        "h", "hr", "hour", "hourly", "per hour", "/h", "stunde", "hora", "час", "時間", "시간", "uur", "per uur", "godz", "godz.",
        "godzinę", "std", "std.", "jam", "ساعة",
    ],
    "day": [
        "d", "day", "daily", "night", "nightly", "per night", "noche", "nuit", "tag", "dia", "día", "сутки", "день", "日", "泊", "일",
        "giorno", "doba", "dag", "dzień", "hari", "يوم", "يومي",
    ],
    "week": [
        "w", "wk", "week", "weekly", "pw", "p.w.", "semana", "semaine", "woche", "неделя", "週", "주", "settimana", "tydzień", "minggu",
        "أسبوع",
    ],
    "month": [
        "m", "mo", "mon", "month", "monthly", "pm", "p.m.", "pcm", "per month", "/mo", "mes", "mês", "mensual", "mensal", "mois",
        "monat", "monatlich", "mese", "мес", "месяц", "месяц.", "月", "월", "miesiąc", "ay", "თვე", "maand", "per maand", "p/m", "mies",
        "mies.", "miesięcznie", "msc", "mc", "bulan", "bln", "sebulan", "شهر", "شهريا", "شهرياً", "monatl.",
    ],
    "year": [
        "y", "yr", "year", "yearly", "annual", "annum", "pa", "p.a.", "año", "ano", "an", "jahr", "anno", "год", "年", "년", "rok",
        "yıl", "jaar", "per jaar", "rocznie", "jährlich", "tahun", "thn", "setahun", "سنة", "سنويا", "سنوياً",
    ],
}
PERIOD_PREFIX = r"^(?:per|a|an|по|al|pro|par|/)\s*"

# ------------------------------------------------------------------------------------------------ dates (fixed values)
TODAY_WORDS = [
    "today", "heute", "hoy", "hoje", "aujourd'hui", "сегодня", "oggi", "bugün", "今日", "今天", "오늘", "დღეს", "just now",
]
YESTERDAY_WORDS = ["yesterday", "gestern", "ayer", "ontem", "hier", "вчера", "ieri", "dün", "昨日", "昨天", "어제", "გუშინ"]
AGO_UNITS = "minute|min|hour|hr|stunde|hora|час|day|tag|día|dia|jour|день|дн|week|woche|semana|недел|month|monat|mes|месяц"
AGO_MINUTES = ["minute", "min"]
AGO_HOURS = ["hour", "hr", "stunde", "hora", "час"]
AGO_WEEKS = ["week", "woche", "semana", "недел"]
AGO_MONTHS = ["month", "monat", "mes", "месяц"]
AGO_AFTER = "ago|назад|zurück"
AGO_BEFORE = r"\b(hace|vor|il y a|há)\b"
# month names and abbreviations, one line per month
MONTH_WORDS = [
    [
        "january", "jan", "januar", "januari", "janvier", "enero", "janeiro", "gennaio", "gen", "styczeń", "stycznia", "sty",
    ],
    [
        "february", "feb", "februar", "februari", "février", "fevrier", "febrero", "fevereiro", "fev", "febbraio", "luty", "lutego",
        "lut",
    ],
    [
        "march", "mar", "märz", "maerz", "mrz", "maart", "mrt", "mars", "marzo", "março", "marco", "marzec", "marca", "maret", "mac",
    ],
    ["april", "apr", "avril", "abril", "aprile", "kwiecień", "kwietnia", "kwi"],
    ["may", "mai", "mei", "mayo", "maio", "maggio", "mag", "maj", "maja"],
    ["june", "jun", "juni", "juin", "junio", "junho", "giugno", "giu", "czerwiec", "czerwca", "cze"],
    ["july", "jul", "juli", "juillet", "julio", "julho", "luglio", "lug", "lipiec", "lipca", "lip", "julai"],
    [
        "august", "aug", "augustus", "août", "aout", "agosto", "ago", "sierpień", "sierpnia", "sie", "agustus", "ogos",
    ],
    [
        "september", "sep", "sept", "septembre", "septiembre", "setembro", "set", "settembre", "wrzesień", "września", "wrz",
    ],
    [
        "october", "oct", "oktober", "okt", "octobre", "octubre", "outubro", "out", "ottobre", "ott", "październik", "października",
        "paź", "paz",
    ],
    ["november", "nov", "novembre", "noviembre", "novembro", "listopad", "listopada", "lis"],
    [
        "december", "dec", "dezember", "dez", "décembre", "decembre", "diciembre", "dic", "dezembro", "dicembre", "grudzień",
        "grudnia", "gru", "desember", "disember", "des",
    ],
]
TIME_OF_DAY = r"(?<![\d:.])([01]?\d|2[0-3])(?:[:h.]([0-5]\d))?\s*(am|pm|a\.m\.|p\.m\.|uhr|h\b)?(?![\d%])"
MONTH_FIRST_COUNTRIES = ["US", "PH", "FM", "PR"]
# countries with one civil time zone
COUNTRY_ZONES = {
    "GB": "Europe/London", "IE": "Europe/Dublin", "DE": "Europe/Berlin", "PL": "Europe/Warsaw", "NL": "Europe/Amsterdam",
    "FR": "Europe/Paris", "ES": "Europe/Madrid", "PT": "Europe/Lisbon", "IT": "Europe/Rome", "BE": "Europe/Brussels",
    "AT": "Europe/Vienna", "CH": "Europe/Zurich", "CZ": "Europe/Prague", "GR": "Europe/Athens", "TR": "Europe/Istanbul",
    "GE": "Asia/Tbilisi", "AZ": "Asia/Baku", "AM": "Asia/Yerevan", "AE": "Asia/Dubai", "SA": "Asia/Riyadh", "EG": "Africa/Cairo",
    "IN": "Asia/Kolkata", "SG": "Asia/Singapore", "MY": "Asia/Kuala_Lumpur", "JP": "Asia/Tokyo", "KR": "Asia/Seoul",
    "CN": "Asia/Shanghai", "HK": "Asia/Hong_Kong", "IL": "Asia/Jerusalem", "UA": "Europe/Kyiv", "BY": "Europe/Minsk",
}
# a date without a year is the next such day, unless it lies at most this many days back
YEAR_BACK_DAYS, YEAR_AHEAD_DAYS = 60, 305

# --------------------------------------------------------------------------------------------- booleans (fixed values)
TRUE_WORDS = ["1", "true", "yes", "y", "si", "sí", "sim", "ja", "oui", "да", "はい", "예", "on", "remote"]
FALSE_WORDS = ["0", "false", "no", "n", "nein", "non", "não", "нет", "いいえ", "아니오", "off"]

# -------------------------------------------------------------------------------------------- identity (fixed values)
LEGAL_SUFFIX = (r"(?:\s+(?:l\s?l\s?c|fz\s?e|fz\s?co|fz\s?llc|opc|est|establishment|co|company|ltd|limited|trading|wll|w\s?l\s?l"
                r"|gmbh|ag|bv|b\s?v|nv|sp\s?z\s?o\s?o|pvt|private|inc|plc|sdn\s?bhd|bhd|pte|tbk|pt|s\s?a|sarl))+$")

# -------------------------------------------------------------------------------------------- cities (fixed values)
CITY_PREFIX = r"^(?:г\.|город|гор\.|city of|ciudad de|cidade de|ville de|stadt|şəhəri|q\.|к\.)\s*"
CITY_PARENTHESIS = r"\s*\([^)]*\)\s*"
CITY_POSTCODE = r"[\s.,]+(?:[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}|\d{4,6}(?:-\d{3,4})?|\d{4}\s?[A-Z]{2})$"
CITY_FIRST_PART = r"\s*[,;|/·]\s*|\s+-\s+"
ADDRESS_SPLIT = r"[,|/·\-–]"
FEATURE_CLASSES = ["P", "A"]

# ------------------------------------------------------------------------------------------- domains (fixed values)
# second-level labels that form a public suffix together with a two-letter top-level domain
GENERIC_SECOND_LEVEL = [
    "co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "go", "gob", "gv", "nic", "ltd", "plc", "info", "biz", "web", "nom",
    "mil",
]
# suffixes that the rule above does not give; "*." is a wildcard, "!" an exception
EXTRA_SUFFIXES = [
    "me.uk", "asn.au", "id.au", "geek.nz", "school.nz", "govt.nz", "gr.jp", "ed.jp", "lg.jp", "blog.br", "art.br", "gen.tr", "av.tr",
    "firm.in", "gen.in", "ind.in", "idv.tw", "my.id", "in.th", "in.ua", "kiev.ua", "msk.ru", "spb.ru", "github.io", "gitlab.io",
    "blogspot.com", "herokuapp.com", "appspot.com", "netlify.app", "vercel.app", "pages.dev", "azurewebsites.net", "cloudfront.net",
    "web.app", "firebaseapp.com", "myshopify.com", "wixsite.com", "githubusercontent.com", "readthedocs.io", "webflow.io",
    "workers.dev", "onrender.com", "fly.dev", "*.ck", "!www.ck",
]
# shared hosts: number of leading path parts that name the owner
OWNER_IN_PATH = {
    "raw.githubusercontent.com": 2, "github.com": 1, "gitlab.com": 1, "codeberg.org": 1, "bitbucket.org": 1,
    "sites.google.com": 2, "docs.google.com": 3, "huggingface.co": 2, "buttondown.com": 1, "medium.com": 1, "linktr.ee": 1,
}
# shared domains whose every subdomain is a site of its own
OWNER_IN_SUBDOMAIN = [
    "substack.com", "wordpress.com", "tumblr.com", "beehiiv.com", "ghost.io", "notion.site", "carrd.co", "wixsite.com",
]

# ------------------------------------------------------------------------------------------- regions (fixed values)
REGION_GROUPS = {
    "EU": [
        "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL",
        "PT", "RO", "SK", "SI", "ES", "SE",
    ],
    "EEA": [
        "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL",
        "PT", "RO", "SK", "SI", "ES", "SE", "IS", "LI", "NO",
    ],
    "DACH": ["DE", "AT", "CH"],
    "BENELUX": ["BE", "NL", "LU"],
    "NORDICS": ["DK", "FI", "IS", "NO", "SE"],
    "BALTICS": ["EE", "LV", "LT"],
    "IBERIA": ["ES", "PT"],
    "BALKANS": ["AL", "BA", "BG", "HR", "XK", "ME", "MK", "RO", "RS", "SI", "GR"],
    "CEE": ["BG", "CZ", "EE", "HR", "HU", "LT", "LV", "PL", "RO", "SI", "SK"],
    "UK_IE": ["GB", "IE"],
    "GCC": ["AE", "BH", "KW", "OM", "QA", "SA"],
    "MENA": [
        "AE", "BH", "DZ", "EG", "IQ", "IL", "JO", "KW", "LB", "LY", "MA", "OM", "PS", "QA", "SA", "SY", "TN", "YE", "IR", "TR",
    ],
    "MAGHREB": ["DZ", "LY", "MA", "MR", "TN"],
    "LEVANT": ["IL", "JO", "LB", "PS", "SY"],
    "NORTH_AMERICA": ["US", "CA", "MX"],
    "CENTRAL_AMERICA": ["BZ", "CR", "SV", "GT", "HN", "NI", "PA"],
    "LATAM": [
        "AR", "BO", "BR", "CL", "CO", "CR", "CU", "DO", "EC", "SV", "GT", "HN", "MX", "NI", "PA", "PY", "PE", "PR", "UY", "VE",
    ],
    "ANDEAN": ["BO", "CO", "EC", "PE"],
    "MERCOSUR": ["AR", "BR", "PY", "UY"],
    "ANZ": ["AU", "NZ"],
    "ASEAN": ["BN", "KH", "ID", "LA", "MY", "MM", "PH", "SG", "TH", "VN"],
    "EAST_ASIA": ["CN", "HK", "JP", "KR", "MO", "MN", "TW"],
    "SOUTH_ASIA": ["AF", "BD", "BT", "IN", "LK", "MV", "NP", "PK"],
    "CENTRAL_ASIA": ["KZ", "KG", "TJ", "TM", "UZ"],
    "CAUCASUS": ["AM", "AZ", "GE"],
    "CIS": ["AM", "AZ", "BY", "KZ", "KG", "MD", "RU", "TJ", "UZ"],
    "EAST_AFRICA": ["BI", "DJ", "ER", "ET", "KE", "RW", "SO", "SS", "TZ", "UG"],
    "WEST_AFRICA": ["BJ", "BF", "CV", "CI", "GM", "GH", "GN", "GW", "LR", "ML", "MR", "NE", "NG", "SN", "SL", "TG"],
    "SOUTHERN_AFRICA": ["BW", "LS", "NA", "SZ", "ZA", "ZM", "ZW", "MZ", "MW"],
    "G7": ["CA", "FR", "DE", "IT", "JP", "GB", "US"],
}
# EUROZONE is the EU members whose currency is EUR, derived in sources.dims
REGION_ALIASES = {"UK": "GB", "EL": "GR", "USA": "US", "UAE": "AE", "KSA": "SA"}
REGION_NAMES = {
    "czech republic": "CZ", "korea": "KR", "great britain": "GB", "england": "GB", "united states of america": "US",
    "russian federation": "RU", "viet nam": "VN", "turkiye": "TR", "türkiye": "TR", "ivory coast": "CI", "holland": "NL",
    "hong kong": "HK", "macao": "MO", "kosovo": "XK",
}
GLOBAL = "GLOBAL"

# --------------------------------------------------------------------------------------------- pages (fixed values)
CHALLENGE_HEAD_CHARS, CHALLENGE_MAX_CHARS, STUB_MAX_TEXT = 6000, 20000, 300
CHALLENGE_MARKERS = [
    "cf-chl", "just a moment...", "attention required", "captcha", "are you a human", "are you a robot", "verify you are human",
    "access denied", "enable javascript and cookies", "ddos-guard", "perimeterx", "distil_r_captcha",
]
STUB_MARKERS = [
    "_incapsula_resource", "incapsula incident", "captcha-delivery.com", "px-captcha", "/cdn-cgi/challenge-platform", "kpsdk",
    "awswaf", "aws-waf-token", "sucuri_cloudproxy", "ddos-guard",
]
ACCESS_BODY_CHARS = 60000
ACCESS_CHALLENGE_BODY = [
    "cf-chl", "challenge-platform", "just a moment...", "attention required", "checking your browser", "captcha", "are you a human",
    "are you a robot", "verify you are human", "enable javascript and cookies", "ddos-guard", "perimeterx", "px-captcha", "_pxhd",
    "captcha-delivery.com", "datadome", "distil_r_captcha", "incapsula", "_incapsula_resource", "kpsdk", "awswaf", "aws-waf-token",
    "pardon our interruption", "unusual traffic", "bot protection", "please wait while we verify", "sucuri website firewall",
    "turnstile",
]
ACCESS_CHALLENGE_HEADERS = [
    "cf-mitigated", "x-datadome", "x-dd-b", "x-px-block", "x-kpsdk-ct", "x-amzn-waf-action", "x-iinfo", "x-sucuri-block",
]
LOGIN_BODY = (r"type=[\"']password[\"']|log ?in to (?:see|view|continue)|sign in to (?:see|view|continue)|please (?:log|sign) in"
              r"|войдите|anmelden, um|inicia sesión para|session expired|you must be logged in")
PAYWALL_BODY = r"subscribe to (?:continue|read)|paywall|subscribers only|premium content|subscription required"
LANE_LOGIN = (r"type=[\"']password[\"']|log ?in to (?:see|view|continue)|sign in to (?:see|view|continue)"
              r"|please (?:log|sign) in|войдите|anmelden, um|inicia sesión para")
LANE_PAYWALL = r"subscribe to (?:continue|read)|paywall|subscribers only|premium content"
LANE_SHELL = r"<div id=[\"'](?:root|app|__next)[\"']\s*>\s*</div>|enable javascript|requires javascript"
FEED_TYPES = ["application/rss+xml", "application/atom+xml", "application/feed+json", "application/json"]
ITEM_TYPES = [
    "Product", "Offer", "AggregateOffer", "Car", "Vehicle", "Motorcycle", "JobPosting", "Event", "RealEstateListing", "Apartment",
    "House", "Residence", "SingleFamilyResidence", "Accommodation", "ItemList",
]
BUSINESS_TYPES = ["LocalBusiness", "Organization", "Place", "Store", "AutoDealer", "RealEstateAgent", "Restaurant"]
STATE_VARIABLES = ["__INITIAL_STATE__", "__PRELOADED_STATE__", "__APOLLO_STATE__", "__DATA__"]
MIN_FEED_ITEMS, FEED_RELATED_SHARE, MIN_BUSINESS_LISTINGS = 3, 0.3, 2
LANE_LOGIN_CHARS, LANE_PAYWALL_CHARS, LANE_HTML_CHARS, LANE_HTML_LINKS = 3000, 5000, 1500, 10
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
]
HIDDEN_TAGS = ["script", "style", "noscript"]

# ------------------------------------------------------------------------------------ runs and health (fixed values)
DEFAULT_ANGLE = "vertical_portals"
FIRST_PAGE_LANES = ["browser"]
REPLACE_MIN_FRACTION = 0.6
MIN_BASELINE_FOR_DEGRADED, DEGRADED_FRACTION = 20, 0.5
FAILED_STOPS = ["import_error", "sha_mismatch", "crashed", "errors"]
MAX_PAGE_ERRORS, MAX_DRY_PAGES = 2, 2
HEALTH_WINDOW_RUNS, RECENT_YIELD_RUNS = 5, 5
SKEW_SECONDS, STUCK_MIN_SECONDS, REALERT_HOURS, MAX_DELIVERY_ATTEMPTS = 300, 600, 24, 20
INCIDENT_KINDS = ["zero", "degraded", "error_streak", "stale", "review_stale"]
CADENCE_HOURS = {"hourly": 1, "6h": 6, "12h": 12, "daily": 24, "weekly": 168, "monthly": 720, "manual": 0}
DEFAULT_CADENCE_HOURS = 24.0
MIN_VALID_FRACTION = 0.8
BLOCKED_FACTOR, DRY_ROUNDS = 3, 2
OFF_BUDGET_STATUS = ["rejected", "blocked", "lane_none"]
ANGLES = [
    "classifieds", "marketplaces", "vertical_portals", "aggregators", "official", "operators", "local_language", "api_catalog",
]
CSV_FORMULA_LEADS = "=+-@\t\r"

# ------------------------------------------------------------------------------------------ patterns (fixed values)
# {months} and {ago} stand for the month words and the relative units above
DATE_WITH_DAY_FIRST = r"(?<!\d)(\d{1,2})(?:st|nd|rd|th|er|\.|º)?\s*(?:de\s+)?({months})\.?(?![^\W\d_])(?:,?\s*(?:de\s+)?(\d{4}))"
DATE_WITH_MONTH_FIRST = r"(?<![^\W\d_])({months})\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?!\d)(?:,?\s*(\d{4}))"
DATE_RELATIVE = r"(\d+)\s*({ago})\w*\s*({after})?"
DATE_YEAR_FIRST = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
DATE_YEAR_LAST = r"(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})"
DATE_CJK = r"(\d{4})(?:年|년\s*)(\d{1,2})(?:月|월\s*)(\d{1,2})(?:日|일)"
GLUED_CURRENCY = r"(?<![^\W\d_])([^\W\d_]{1,3}\.?)(?=\d)"
PERIOD_AFTER_SLASH = r"/\s*([^\W\d_]{1,4})\.?(?![^\W_]|[²³])"
TAG = r"</?[A-Za-z!?][^>]*>"
HIDDEN_BLOCK_TO_END = r"<(script|style|noscript)\b[^>]*>.*?(</\1\s*>|\z)"
HIDDEN_BLOCK = r"<(script|style|noscript)\b.*?</\1>"
