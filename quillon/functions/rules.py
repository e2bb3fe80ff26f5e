"""Rule tables of name and address normalization."""

# Every entry must be as it is for results to agree.

LEGAL = {
    "private": "pvt", "pvt": "pvt", "pte": "pvt", "limited": "ltd", "ltd": "ltd", "ltda": "ltd", "incorporated": "inc", "inc": "inc",
    "corporation": "corp", "corp": "corp", "company": "co", "co": "co", "cie": "co", "llc": "llc", "llp": "llp", "lp": "lp", "pllc": "pllc",
    "pc": "pc", "pa": "pa", "plc": "plc", "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sa": "sa", "sci": "sci", "eurl": "eurl", "snc": "snc",
    "ei": "ei", "selarl": "selarl",
}

#: Spelled-out legal forms and what they are glued to, in the order they are applied.
LEGAL_PATTERNS = (
    (r"\bs\s*\.?\s*a\s*\.?\s*r\s*\.?\s*l\b\.?", " sarl "),
    (r"\bs\s*\.\s*a\s*\.\s*s\s*\.?", " sas "),
    (r"\bs\s*\.\s*a\s*\.", " sa "),
    (r"\bl\s*\.\s*l\s*\.\s*c\s*\.?", " llc "),
    (r"\bl\s*\.\s*l\s*\.\s*p\s*\.?", " llp "),
    (r"\bp\s*\.\s*c\s*\.", " pc "),
    (r"\bpvt\s*-\s*ltd\b", " pvt ltd "),
)

NAME_NOISE = ("mr", "mrs", "ms", "dr", "smt", "sri", "shri", "the", "of", "and", "et", "m/s")
WEB_TLDS = ("com", "in", "net", "org", "co", "fr", "biz", "info", "us")
#: Digits inside words and the letters they stand for.
LEET = ("0134578", "oleastb")

ADDR_ABBR = {
    "street": "st", "str": "st", "avenue": "ave", "av": "ave", "avn": "ave", "road": "rd", "drive": "dr", "lane": "ln", "boulevard": "blvd",
    "bd": "blvd", "bvd": "blvd", "court": "ct", "circle": "cir", "place": "pl", "parkway": "pkwy", "highway": "hwy", "trail": "trl",
    "terrace": "ter", "terr": "ter", "square": "sq", "route": "rte", "rue": "rue", "r": "rue", "chemin": "chem", "ch": "chem", "impasse": "imp",
    "allee": "all", "quai": "qu", "cours": "crs", "point": "pt", "mount": "mt", "fort": "ft", "saint": "st", "sainte": "ste",
    "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
    "near": "nr", "opposite": "opp", "industrial": "indl", "indl": "indl", "nagar": "ngr", "ngr": "ngr", "colony": "col", "sector": "sec",
    "sec": "sec", "building": "bldg", "bldg": "bldg", "apartment": "apt", "apartments": "apt", "apts": "apt", "floor": "flr", "fl": "flr",
    "flr": "flr", "bengaluru": "bangalore", "bombay": "mumbai", "madras": "chennai", "calcutta": "kolkata", "gurugram": "gurgaon",
    "ahmadabad": "ahmedabad",
}

ADDR_DROP = (
    "no", "nos", "number", "h", "hno", "house", "unit", "suite", "ste", "#", "po", "box", "c", "o", "cdp", "city", "of", "the", "de", "du",
    "des", "la", "le", "les", "d", "l", "cedex", "door", "plot", "flat", "shop", "dist", "district", "tal", "taluka", "vill", "village",
    "post", "at", "and", "&", "bis", "ter",
)

ADDR_GENERIC = (
    "st", "ave", "rd", "dr", "ln", "blvd", "ct", "cir", "pl", "pkwy", "hwy", "trl", "ter", "sq", "rte", "rue", "chem", "imp", "all", "n", "s",
    "e", "w", "ne", "nw", "se", "sw", "nr", "opp", "main", "cross", "block", "sec", "ngr", "col", "bldg", "apt", "flr", "road", "ground",
    "first", "second", "phase", "stage", "layout", "area", "west", "east",
)

STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia",
    "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi",
    "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh",
    "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn",
    "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi",
    "wyoming": "wy", "district of columbia": "dc",
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj",
    "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp",
    "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od",
    "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "ts", "tripura": "tr", "uttar pradesh": "up",
    "uttarakhand": "uk", "west bengal": "wb", "delhi": "dl", "jammu and kashmir": "jk", "chandigarh": "ch", "puducherry": "py",
}

#: Words that begin a unit of an address, and French house-number suffixes.
UNIT_WORDS = ("shop", "shp", "unit", "suite", "ste", "apt", "flat", "office", "off", "room", "rm", "gala", "stall", "bat", "batiment")
SUFFIXES = {"bis": "b", "ter": "c", "quater": "d"}

#: A number after a unit word, and one that needs none.
UNIT_NUMBER = r"^[a-z]{0,2}-?[0-9]+[a-z]?$"
DASHED_NUMBER = r"^[a-z]{1,2}-[0-9]+$"

#: What is cut from names and addresses, and the words that digits may stand for letters in: fixed patterns.
AFTER_BAR = r"\|.*$"
BRACKETED = r"\[[^\]]*\]|\(\s*id\s*:?\s*\d+\s*\)"
MESSRS = r"\bm\s*/\s*s\b"
LONG_NUMBER = r"^[0-9]{4,}$"
ORDINAL = r"^\d+(?:st|nd|rd|th)$"
NUMBER_SIGN = r"\bn\s*[°º]"
LEET_WORD = r"^(?:[013458][a-z]{2,}|[a-z]{2,}[013458]|[a-z]+[013458][a-z]+)$"

#: Largest block of each key kind on the records' side, and its bit in a pair's set of kinds.
CAPS = {"nw": 200, "np": 200, "nt": 30, "cc": 50, "ap": 200, "nn": 200, "hw": 200, "nr": 300, "ca": 200}
KIND_BITS = {"nw": 1, "np": 2, "nt": 4, "cc": 8, "ap": 16, "nn": 32, "hw": 64, "nr": 128, "em": 256, "ca": 512}
ENTITY_CAP = 200
