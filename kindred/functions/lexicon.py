"""Fixed word lists of the record-linkage rules. They must be as given for equal results."""

#: Legal forms at the end of a business name.
LEGAL_SUFFIXES = [
    "private limited", "private ltd", "pvt limited", "pvt ltd", "public limited", "public ltd", "limited liability company", "limited liability co", "limited", "ltd", "llc", "llp",
    "incorporated", "inc", "corporation", "corp", "company", "co", "private", "pvt", "societe anonyme", "société anonyme", "sarl", "sas", "s.a.s", "sa", "gmbh", "ag", "plc", "bv", "nv",
    "pte ltd", "pty ltd",
]
#: Single-word legal forms of the lighter key profile.
LIGHT_SUFFIXES = ["inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "pvt", "private", "llp"]
#: Address words that tell nothing.
GENERIC_ADDRESS_TOKENS = [
    "street", "st", "road", "rd", "avenue", "ave", "boulevard", "blvd", "lane", "ln", "drive", "dr", "highway", "hwy", "parkway", "pkwy", "place", "pl", "way", "square", "sq", "building",
    "bldg", "floor", "fl", "unit", "suite", "ste",
]
#: State codes that may stand before a US postal code.
US_STATES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc"
).split()
#: Strings that a reader with default missing-value parsing takes for missing.
MISSING_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Joins a country and a value to a lookup key.
SEPARATOR = "\x1f"
