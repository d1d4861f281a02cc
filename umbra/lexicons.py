"""Word lists, tables and patterns that results must agree on."""

# Fixed values.
STREET_WORDS = [
    "road", "rd", "street", "st", "avenue", "ave", "drive", "dr", "lane", "ln", "place", "pl", "walk", "close", "crescent", "cres", "way",
    "boulevard", "blvd", "grove", "terrace", "park", "gardens", "garden", "hill", "view", "rise", "link", "loop", "quay", "green", "field", "circle",
    "court", "ct", "highway", "hwy", "parkway", "pkwy", "plaza", "square", "sq", "alley", "path", "trail", "row", "promenade", "parade", "esplanade",
    "strand", "arcade", "boardwalk", "circuit", "cove", "mews", "concourse",
]
# Fixed values.
STREET_PREFIXES = [
    "jalan", "lorong", "lebuh", "taman", "lingkaran", "persiaran", "lebuhraya", "susur", "medan", "kompleks", "wisma", "menara", "gang", "kampung",
    "kelurahan", "kecamatan", "rue", "avenue", "boulevard", "calle", "avenida", "paseo", "via", "viale", "piazza", "strasse", "straße", "platz",
]
# Fixed values.
CORPORATE_SUFFIXES = [
    "ltd", "co", "inc", "corp", "pte", "plc", "llc", "llp", "gmbh", "sa", "ag", "bhd", "sdn", "kk", "oy", "ab", "as", "nv", "bv", "spa", "srl",
    "limited", "incorporated", "corporation", "company", "holdings",
]
# Fixed values.
BUILDING_WORDS = [
    "tower", "towers", "building", "centre", "center", "plaza", "house", "mall", "complex", "mansion", "arcade", "point", "square", "annexe", "annex",
    "block", "wing", "podium", "hub", "quarter",
]
# Fixed values.
DEFINED_TERMS = [
    "vessel", "vessels", "charter", "charterer", "charterers", "owner", "owners", "master", "crew", "cargo", "port", "voyage", "freight", "hire",
    "ship", "fleet", "berth", "bunkers", "flag", "company", "companies", "agreement", "contract", "party", "parties", "buyer", "seller", "purchaser",
    "vendor", "lessor", "lessee", "tenant", "landlord", "licensor", "licensee", "borrower", "lender", "guarantor", "indemnitor", "indemnitee",
    "assignor", "assignee", "grantor", "grantee", "trustee", "beneficiary", "manager", "director", "officer", "shareholder", "member", "client",
    "customer", "supplier", "contractor", "employer", "employee", "background", "annex", "annexure", "appendix", "schedule", "exhibit", "attachment",
    "recital", "preamble", "clause", "section", "article", "part", "chapter", "definitions", "notice", "certificate", "instrument", "deed", "summary",
    "overview", "introduction", "conclusion", "scope", "purpose", "methodology", "property", "premises", "site", "facility", "equipment", "product",
    "service", "services", "goods", "asset", "assets", "fund", "account", "policy", "group", "entity", "business", "corporation", "enterprise",
    "firm", "organization", "organisation", "division", "department", "unit", "branch", "subsidiary", "affiliate", "holding", "holdings", "fy", "ytd",
    "qtd", "mtd", "ttm", "eoy", "cy", "q1", "q2", "q3", "q4", "h1", "h2", "fye",
]
# Fixed values.
FIRST_NAMES = [
    "John", "Jane", "Julian", "Jasmine", "Jason", "Julia", "Jacob", "Joanna", "Justin", "Jocelyn", "James", "Joyce", "Jerome", "Jenny", "Joel", "Jia",
    "Jared", "Juliet", "Jonathan", "Janet", "Jack", "Judy",
]
# Fixed values.
LAST_NAMES = [
    "Doe", "Des", "Davis", "Dixon", "Douglas", "Dunn", "Diaz", "Drake", "Duncan", "Dela Cruz", "Daniels", "Dorset", "Dawson", "Devi", "Damar", "Din",
    "Dutta", "Deng", "Duval", "Dias", "Doherty",
]
# Fixed values.
COUNTRIES = [
    "Afghanistan", "Albania", "Algeria", "Andorra", "Angola", "Antigua and Barbuda", "Argentina", "Armenia", "Australia", "Austria", "Azerbaijan",
    "Bahamas", "Bahrain", "Bangladesh", "Barbados", "Belarus", "Belgium", "Belize", "Benin", "Bhutan", "Bolivia", "Bosnia and Herzegovina",
    "Botswana", "Brazil", "Brunei", "Bulgaria", "Burkina Faso", "Burundi", "Cabo Verde", "Cambodia", "Cameroon", "Canada", "Central African Republic",
    "Chad", "Chile", "China", "Colombia", "Comoros", "Congo", "Costa Rica", "Croatia", "Cuba", "Cyprus", "Czechia", "Denmark", "Djibouti", "Dominica",
    "Dominican Republic", "Ecuador", "Egypt", "El Salvador", "Equatorial Guinea", "Eritrea", "Estonia", "Eswatini", "Ethiopia", "Fiji", "Finland",
    "France", "Gabon", "Gambia", "Georgia", "Germany", "Ghana", "Greece", "Grenada", "Guatemala", "Guinea", "Guinea-Bissau", "Guyana", "Haiti",
    "Honduras", "Hong Kong", "Hungary", "Iceland", "India", "Indonesia", "Iran", "Iraq", "Ireland", "Israel", "Italy", "Ivory Coast", "Jamaica",
    "Japan", "Jordan", "Kazakhstan", "Kenya", "Kiribati", "Kosovo", "Kuwait", "Kyrgyzstan", "Laos", "Latvia", "Lebanon", "Lesotho", "Liberia",
    "Libya", "Liechtenstein", "Lithuania", "Luxembourg", "Macau", "Madagascar", "Malawi", "Malaysia", "Maldives", "Mali", "Malta", "Marshall Islands",
    "Mauritania", "Mauritius", "Mexico", "Micronesia", "Moldova", "Monaco", "Mongolia", "Montenegro", "Morocco", "Mozambique", "Myanmar", "Namibia",
    "Nauru", "Nepal", "Netherlands", "New Zealand", "Nicaragua", "Niger", "Nigeria", "North Korea", "North Macedonia", "Norway", "Oman", "Pakistan",
    "Palau", "Palestine", "Panama", "Papua New Guinea", "Paraguay", "Peru", "Philippines", "Poland", "Portugal", "Qatar", "Romania", "Russia",
    "Rwanda", "Saint Kitts and Nevis", "Saint Lucia", "Saint Vincent and the Grenadines", "Samoa", "San Marino", "Sao Tome and Principe",
    "Saudi Arabia", "Senegal", "Serbia", "Seychelles", "Sierra Leone", "Singapore", "Slovakia", "Slovenia", "Solomon Islands", "Somalia",
    "South Africa", "South Korea", "South Sudan", "Spain", "Sri Lanka", "Sudan", "Suriname", "Sweden", "Switzerland", "Syria", "Taiwan", "Tajikistan",
    "Tanzania", "Thailand", "Timor-Leste", "Togo", "Tonga", "Trinidad and Tobago", "Tunisia", "Turkey", "Turkmenistan", "Tuvalu", "Uganda", "Ukraine",
    "United Arab Emirates", "United Kingdom", "United States", "Uruguay", "Uzbekistan", "Vanuatu", "Vatican City", "Venezuela", "Vietnam", "Yemen",
    "Zambia", "Zimbabwe",
]
# Fixed values.
REGIONS = [
    "Africa", "Antarctica", "Asia", "Europe", "North America", "South America", "Oceania", "Americas", "Middle East", "Far East", "South East Asia",
    "Southeast Asia", "North East Asia", "Northeast Asia", "East Asia", "South Asia", "Central Asia", "Central America", "Latin America", "Caribbean",
    "Scandinavia", "Nordic", "Nordics", "Balkans", "Sub-Saharan Africa", "North Africa", "West Africa", "East Africa", "Southern Africa",
    "Asia Pacific", "APAC", "EMEA", "LATAM", "ANZ", "Indochina", "Indian Subcontinent", "British Isles", "Iberia", "Benelux", "Gulf", "GCC", "ASEAN",
]
# Fixed values.
COUNTRY_ALIASES = {
    "united states of america": "United States", "russian federation": "Russia", "republic of korea": "South Korea",
    "democratic people's republic of korea": "North Korea", "people's republic of china": "China", "republic of china": "Taiwan",
    "uae": "United Arab Emirates", "uk": "United Kingdom", "us": "United States", "usa": "United States", "u.s.a.": "United States",
    "u.k.": "United Kingdom",
}
# Fixed values.
STATE_COUNTRIES = {
    "wa": "Australia", "nsw": "Australia", "vic": "Australia", "qld": "Australia", "sa": "Australia", "tas": "Australia", "nt": "Australia",
    "act": "Australia",
}

# The detectors' patterns.
DASHES = "\\-\u2010\u2011\u2012\u2013\u2014\u2212"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = rf"(?U)(?<![\w{DASHES}])(?:\+\d{{1,3}}[ .{DASHES}]?)?(?:\(\d{{2,4}}\)[ .{DASHES}]?)?\d{{3,4}}[ .{DASHES}]\d{{3,4}}(?!\d)"
UEN = r"(?U)\b(?:\d{9}[A-Za-z]|[A-Za-z]\d{2}[A-Za-z]{2}\d{4}[A-Za-z]|\d{7,8}[A-Za-z])\b"
ABN = r"(?U)\b\d{2}\s\d{3}\s\d{3}\s\d{3}\b"
_streets = "|".join(sorted({*STREET_WORDS, "gardens?"}, key=lambda w: (-len(w), w)))
ADDRESS = rf"(?iu)(?U:\b)\d{{1,4}}[A-Za-z]?\s+[A-Z][A-Za-z'.]*(?:\s+[A-Z][A-Za-z'.]*)*\s+(?:{_streets})(?U:\b)(?:\s*,?\s*#\d{{1,3}}-\d{{1,5}})?(?:,?\s*Singapore(?:\s+\d{{6}})?)?"
# How each category is replaced.
GENERATORS = {"Individual": "name", "Name": "name", "UEN": "hash", "ABN": "hash", "Phone": "hash", "Address": "address", "Location": "address", "Email": "email"}
# The order in which categories are shown.
CATEGORY_ORDER = ["Client", "Entity", "Individual", "Email", "Phone", "UEN", "ABN", "Address", "Location"]
