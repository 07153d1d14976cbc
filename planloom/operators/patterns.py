"""What lines of drawings look like. Fixed values, all matched in any case unless noted; written for Java and RE2 alike."""

STATES = (
    r"ALABAMA|ALASKA|ARIZONA|ARKANSAS|CALIFORNIA|COLORADO|CONNECTICUT|DELAWARE|FLORIDA|GEORGIA|HAWAII|IDAHO|ILLINOIS|INDIANA|IOWA|KANSAS|KENTUCKY|LOUISIANA|MAINE|MARYLAND|MASSACHUSETTS|MICHIGAN|MINNESOTA|MISSISSIPPI|"
    r"MISSOURI|MONTANA|NEBRASKA|NEVADA|NEW\s+HAMPSHIRE|NEW\s+JERSEY|NEW\s+MEXICO|NEW\s+YORK|NORTH\s+CAROLINA|NORTH\s+DAKOTA|OHIO|OKLAHOMA|OREGON|PENNSYLVANIA|RHODE\s+ISLAND|SOUTH\s+CAROLINA|SOUTH\s+DAKOTA|"
    r"TENNESSEE|TEXAS|UTAH|VERMONT|VIRGINIA|WASHINGTON|WEST\s+VIRGINIA|WISCONSIN|WYOMING"
)

# ---- contact
PHONE = r"(?:PHONE|TEL|FAX)?\s*[\(:]?\s*(\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4})"
STANDALONE_PHONE = r"\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}"
FAX = r"FAX\s*[\(:]?\s*(\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4})"
ZIP_LINE = r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"  # capitals only
STATE_ZIP = rf"\b(?:[A-Z]{{2}}|{STATES})\s+\d{{5}}(?:-\d{{4}})?\b"
STREET = r"^\d{1,6}\s+[A-Z0-9][\w\s.,#'-]{3,80}$"
ONE_LINE_ADDRESS = rf"^\d{{1,6}}\s+.+\b(?:[A-Z]{{2}}|{STATES})\s+\d{{5}}(?:-\d{{4}})?\b"
STREET_TO_ZIP = r"^\d{1,6}\s+.+\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"

# ---- labels and values
AGENT_LABEL = r"^\s*AGENT\s*:\s*(.*)$"
JOB_LABEL = r"^\s*JOB\s+NUMBER\s*:\s*(.*)$"
JOB_VALUE = r"^\d{4,6}\.\d{2}$"
DATE_LABEL = r"^\s*DATE\s*:\s*(.*)$"
DATE_VALUE = (
    r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}-\d{2}-\d{2}|(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\s+\d{1,2},?\s+\d{4}|"
    r"\d{1,2}\s+(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\s+\d{4})\b"
)
LICENCE_LINE, LICENCE = r"^C-\d{4,6}$", r"\b(C-\d{4,6})\b"
STATE_NUMBER_LABELLED = r"\bDSA\s*#?\s*[:.]?\s*(0\d-\d{5,7})\b"
STATE_NUMBER = r"\b(0\d-\d{5,7})\b"
STATE_NUMBER_FEATURE = r"\b(\(E\)|RAMP|RESTROOM|SOLAR|PLAYGROUND|PARKING|BUILDING|BLDG)\b"
LABEL = (
    r"^(DATE(\s+PLOTTED)?|JOB\s+NUMBER|SHEET(\s+TITLE)?|SHEET\s+NO\.?|REVISION|AGENT|PHONE|TEL|FAX|SCALE|DRAWN\s+BY|CHK\s*BY|DWG\s*BY|"
    r"PROJECT\s+OWNER|DETAIL\s+VIEW|ROOM\s+NUMBER|FILE\s+LOCATION)\s*:?\s*$"
)

# ---- parties and titles
COMPANY = r"\b(COMPANY|INC\.?|LLC|LLP|LTD\.?|CORP\.?|ARCHITECTS?|ENGINEERING|ENGINEERS?|CONSULTANTS?|GROUP|ASSOCIATES|PARTNERS)\b"
NO_COMPANY = ("DOES NOT REPRESENT", "DISCLAIMS", "PRECEDENCE", "WASTE MANAGEMENT", "SPECIFICATIONS ARE", "DESIGNER/ENGINEER", "INSPECTOR OF RECORD", "OWNER AND CONTRACTOR")
DISTRICT = r"\b(SCHOOL\s+DISTRICT|UNIFIED|DISTRICT)\b"
DISCIPLINE = r"^(CIVIL|STRUCTURAL|MECHANICAL|ELECTRICAL|TECHNOLOGY|ACOUSTICAL|LANDSCAPE|FIRE\s+PROTECTION)\s+(ENGINEER|ENGINEERING|CONSULTANT)S?\s*$"
SPACED_DISCIPLINE = r"^(CIVIL|STRUCTURAL|MECHANICAL|ELECTRICAL|TECHNOLOGY)ENGINEERS?$"
SCHOOL = r"\b([A-Z][A-Z\s.'-]{2,40}\s+(?:ES|MS|HS|ELEMENTARY|MIDDLE|HIGH(\s+SCHOOL)?))\b"
TITLE_GOES_ON = r"\b(MODERNIZATION|SITE\s+IMPROVEMENTS?|ROOF\s+(RESTORATION|REPLACEMENT)|INFRASTRUCTURE|CONSTRUCTION\s+DOCUMENTS?)\b"
TITLE_WORD = r"\b(ELEMENTARY|MIDDLE|HIGH\s+SCHOOL|SCHOOL|ROOF|MODERNIZATION|RESTORATION|REPLACEMENT|BID)\b"
NO_TITLE = ("COVER SHEET", "CONSTRUCTION DOCUMENTS", "DRAWING INDEX", "SCOPE", "REVISION", "SHEET", "PHONE", "TEL ", "FAX")
BAD_TITLE = r"^(PROJECT\s+NAME|SCHOOL\s+NAME|PROJECT\s+TITLE|SHEET\s+TITLE|PROJECT\s+NAME/SCHOOL|NAME/SCHOOL)\b"
BAD_AGENT = r"\b(CODE\s+DATA|DATA|SHEET|TITLE|INDEX|LEGEND|NORTH|GARLAND)\b"
NOT_A_NAME = (
    r"\b(ELEMENTARY|MIDDLE|HIGH|SCHOOL|DISTRICT|APPROVAL|STAMP|SHEET|TITLE|DETAIL|VIEW|ROOM|NUMBER|AGENCY|PROFESSIONAL|COVER|PLAN|INDEX|GARLAND|COMPANY|ENGINEER|ARCHITECT|CENTER|CENTRE|PLOTTED|DATE|CONSTRUCTION|DOCUMENTS|"
    r"INFRASTRUCTURE|UPGRADE|PROJECT|DRAFTING|ITEMS|CONTRACTOR|FURNISHED|PROTECTION|ASSOCIATION|POINT|WORK|ACADEMY|LANGUAGE|HOMES|VISTA|SALAZAR'S|CODE|DATA|LEGEND|NORTH|ASSISTIVE|LISTENING|SYSTEM|DEVICE|ALARM|FIRE|SMOKE|PANEL)\b"
)
DISCLAIMER = r"DSA\s+(CERTIFIED|ACCEPTED)|DOES\s+NOT\s+REPRESENT|SHALL\s+BE\s+EMPLOYED|TESTING\s+LABORATORY|DIRECTLY\s+EMPLOYED"
FILE_NAME = r"\.(RVT|DWG|PDF|DOCX?)\b"

# ---- status, kind of work, lists
STATUS = r"\b(CONSTRUCTION\s+DOCUMENTS?|BID\s+SET|FOR\s+BID|DSA\s+SUBMITTAL|ISSUED\s+FOR\s+[A-Z][A-Z\s]{2,40})\b"
WORK_TYPE = r"\b(ROOF\s+RESTORATION|ROOF\s+REPLACEMENT|MODERNIZATION(?:\s*&\s*SITE\s+IMPROVEMENTS?)?|SITE\s+IMPROVEMENTS?|INFRASTRUCTURE\s+UPGRADE|HVAC\s+REPLACEMENT)\b"
BUILDING_CODE = r"\b(CALIFORNIA\s+(?:BUILDING|ELECTRICAL|MECHANICAL|PLUMBING|FIRE|GREEN\s+BUILDING|ENERGY|ADMINISTRATIVE)\s+CODE|TITLE\s+24|CCR(?:\s*,?\s*TITLE\s+24)?|\bCBC\b|\bCEC\b|\bCMC\b|\bCPC\b|\bCFC\b|\bCALGreen\b)"
SUMMARY_STRONG = r"\b(PROVIDE\s+NEW\s+HVAC|REPLACEMENT\s+IN-KIND\s+OF\s+HVAC|NEW\s+HVAC\s+SYSTEMS?|HVAC\s+EQUIPMENT|HVAC\s+CONTROLS)\b"
SUMMARY_VERB = r"^(PROVIDE|INSTALL|REPLACE|REMOVE|DEMOLISH|INCLUDE)\b"
SUMMARY_NOT = r"\b(ABBREVIATION|SEE\s+MECHANICAL/PLUMBING|SEISMIC\s+ANCHORAGE|SHALL\s+CONFORM|SHALL\s+BE\s+PROVIDED\s+BY\s+THE\s+CONTRACTOR)\b"
TITLE_PAGE = r"\b(AGENT\s*:|PROJECT\s+OWNER|THE\s+GARLAND|JOB\s+NUMBER|DATE\s*:|DSA\s*#|CONSTRUCTION\s+DOCUMENT|SCHOOL\s+DISTRICT)\b"
SCOPE_PAGE = r"\b(SCOPE(\s+OF\s+WORK)?|SUMMARY\s+OF\s+WORK|GENERAL\s+NOTES)\b"

# ---- scope
SCOPE_HEADING = r"^(?:SHT\s+\d+\s*[-–]?\s*)?(.+?\s+)?SCOPE(?:\s+OF\s+WORK)?(?:\s*:.*)?$"
NOTES_HEADING = r"^(SUMMARY\s+OF\s+WORK|WORK\s+INCLUDES|GENERAL\s+NOTES)(?:\s*:.*)?$"
HEADING_SENTENCE = r"\b(SHALL|WILL|REQUIRED\s+TO|CONTRACTOR|COMPLETE\s+THE|MATERIALS|RESPONSIBLE|INCLUDING|PROVIDE|INSTALL|REMOVE)\b"
GENERIC_TITLE = r"^(?:SHT\s+\d+\s*[-–]?\s*)?SCOPE(?:\s+OF\s+WORK)?(?:\s*[:\-].*)?$"
NUMBERED = r"^\s*(\d+)\.\s*(.*)$"
SHEET_CHROME = r"^(OF\s+SHEET|REVISION|DATE:|CHK\s*BY|DWG\s*BY|PHONE|TEL\b|THE\s+GARLAND)"
WORK_VERB = (
    r"\b(REMOVE|DISPOSE|INSTALL|NAIL|FASTEN|PERFORM|APPLY|CLEAN|TEST|ENSURE|REPLACE|PROVIDE|PATCH|PAINT|POWER\s+WASH|MECHANICALLY|FLOOD\s+COAT|RECEIVE|COORDINATE|DEMOLISH|SEAL|PRIME|SAND|REPAIR|ESTABLISH|FURNISH|"
    r"COMPLY|REVIEW|HOLD|SLEEVED|PROHIBITED|RE-?CABLE|CUTOVER)\b"
)
JUNK_ITEM = r"^(TYP\.?|XP|BLDG\.?\s*#?|V\.?I\.?F\.?|\d+[A-Z]?-\d+[A-Z]?|\d{1,3}(\.\d+)?|N/?A)$|V\.?I\.?F\.?|TYP\.\s*\d|^\(?[EN]\)\s|\bSEE\s+PLANS\s+AND\s+SPECIFICATIONS\s+FOR\s+ALL\s+OTHER\b"
TITLE_BLOCK = (
    r"^(PHONE|TEL|FAX|AGENT|DATE|CHK\s*BY|DWG\s*BY|DRAWN\s*BY|REVISION|SHEET|OF|SINCE\s+\d{4})\b|\b(PHONE|FAX)\s*\(?\d{3}\)?|\bTHE\s+GARLAND\s+COMPANY\b|\bGARLAND\b$|\bSCHOOL\s+DISTRICT\b|"
    r"\b(ELEMENTARY|MIDDLE|HIGH)\s+SCHOOL\b|^\d{1,6}\s+.+\b(OHIO|CA|CALIFORNIA|OH)\b.+\d{5}|^[A-Z]{2,4}$|^\d{1,2}-\d{1,2}-\d{2,4}$"
)
SCHEDULE = (
    r"^(DATA LOCATION|SEE\s+\d{2}\s+\d{2}|PANDUIT|OFCI|ARUBA|CHATSWORTH|CAT6A DATA DROP LOCATION|INTERIOR WIRELESS|EXTERIOR WIRELESS|LADDER RACK|INTERCOM CONSOLE|T-\d{3}\b|NQ-CON|"
    r"TECHNOLOGY INFRASTRUCTURE\s+(FLOOR|RCP|SITE|DETAILS|SINGLE|COVER)|TECHNOLOGY SHEET INDEX|TECHNOLOGY SYMBOL LEGEND|Autodesk Docs:|WRITTEN DIMENSIONS ON THESE DRAWINGS|THESE PLANS OR THE SPECIFICATIONS ARE SUITABLE)\b"
)
PART_NUMBER, SCHEDULE_CELLS = r"^[A-Z0-9][A-Z0-9\-_/]{1,20}$", ("AP", "WP", "N/A", "OFCI", "OFCI.", "EMT", "GRC")  # the pattern in capitals only
TECHNOLOGY_SHEET = r"\bTECHNOLOGY INFRASTRUCTURE\s+(FLOOR|RCP|SITE|DETAILS|SINGLE|COVER)\b"
DIMENSION = r"\d+'-\d+"
STAMP_WORD = r"\b(PHONE|FAX|AGENT|GARLAND|CHK\s*BY|DWG\s*BY)\b"

# ---- report clean-up
BAD_VALUE = (
    r"^(SHEET(\s+TITLE)?|JOB\s+NUMBER|DATE(\s+PLOTTED)?|REVISION|DETAIL\s+VIEW|OF|N/?A|—|-|CHK\s*BY|DWG\s*BY|DRAWN\s+BY|BREAK\s+LINE|NOT\s+FOR|PRODUCT\s+SUBMITTALS|COLUMN\s+GRID|ACOUSTICAL\s+CEILING|G\s+OR\s+GB)$"
)
REPORT_DISCLAIMER = r"DSA\s+CERTIFIED|DOES\s+NOT\s+REPRESENT|SHALL\s+BE\s+EMPLOYED|WASTE\s+MANAGEMENT|PROPERTY\s+LINE|TESTING\s+LABORATORY"
NOT_PERSONISH = r"\b(VIEW|SHEET|TITLE|PLAN|INDEX|ITEMS|LINE|BREAK|SUBMITTALS|CEILING|GRID|COLUMN|PRODUCT)\b"
SPACED_LETTERS = r"^(?:[A-Za-z]\s+){3,}[A-Za-z]$"
SHEET_CODE = r"\b\d?[A-Z]{1,3}-?\d{2,3}[A-Z]?\b"  # capitals only
SHEETS_TOTAL, PLAN_WORDS = r"SHEETS?\s+TOTAL\s*:", r"\b(DEMO\s+&?\s*NEW\s+FLOOR\s+PLANS|TITLE\s+24)\b"
REPORT_CHROME = r"\b(PHONE|FAX)\s*\(?\d{3}\)?|\bTHE\s+GARLAND\s+COMPANY\b|\bSCHOOL\s+DISTRICT\b|^\s*AGENT\b"
REPORT_VERB = r"\b(REMOVE|INSTALL|NAIL|FASTEN|PERFORM|APPLY|CLEAN|TEST|REPLACE)\b"
REPORT_KEYNOTE = r"\bTYP\.?\s*\d|V\.?I\.?F\.?|\d+'-\d+"
CALLOUT, CALLOUT_CODE, CALLOUT_START = r"\b(SALVAGED|FLAGPOLE|ASPHALT CONCRETE PAVING)\b", r"\b\d{2}\.[A-Z]\b", r"^\d{1,3}\.[A-Z]\b"  # the codes in capitals only
VAGUE_TITLES = ("SCOPE", "THE ENTIRE SCOPE OF WORK", "FOR THE ENTIRE SCOPE OF WORK", "NEW SCOPE OF WORK")
FIRST_TRADES = r"\b(MECHANICAL|HVAC|ROOF|RESTORATION|LIQUID\s+APPLIED)\b"
OTHER_TRADES = r"REPAINT|PAINT|TECHNOLOGY|ELECTRICAL|PLUMBING|DEMOLITION|FIRE\s+ALARM|INTRUSION"

# ---- firms in logos
LOGO_FIRM = (
    r"(\d{2,4}\s*ARCHITECTS?|[A-Z][A-Za-z0-9.&'\-]+\s+(?:Design|Architecture|Architects)(?:\s+Inc\.?)?|[A-Z][A-Za-z0-9.&'\-]+\s+(?:Inc\.?|LLC|LLP|Studio|Group))"
)
NO_LOGO = ("SCHOOL DISTRICT", "PROJECT OWNER", "CONSTRUCTION DOCUMENT", "DOES NOT REPRESENT", "DISCLAIMS", "SUITE", "TEL ", "PHONE", "FAX")
#: Stamps known by the last seven digits of the phone or words of the street; a postcode alone is too weak.
STAMPS = {"196 Architects": ("7154470", "hedding")}
DEVICE_TYPES = ("supply_air_diffuser", "return_air_grille", "exhaust_grille", "co2_sensor", "temperature_sensor", "thermostat", "vav_box")
