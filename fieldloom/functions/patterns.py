"""The patterns, keyword lists and labels each profile matches.

These must equal the behaviour being reproduced, so they are stated plainly,
in the order they are tried.  Patterns are written in Python syntax and go
through :func:`fieldloom.functions.rx.py` before reaching Spark.
"""

from fieldloom.functions.rx import one_of

# --- shared tokens -----------------------------------------------------------
DOCNO = r"[A-Za-z0-9/\-_]+"
DATE_NUM = r"\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}"
DATE_MON = r"\d{1,2}[A-Za-z]{3}\d{2,4}"
TAXID = r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]{1}[Z]{1}[0-9A-Z]{1}"
# Digit groups joined by single commas.  Written as one character class under the
# repetition (never two commas in a row, a digit at the end): a repeated group of
# varying length recurses once per repetition and overflows the stack on long runs.
NUM_COMMAS = r"\d(?:[\d,](?<!,,))*(?<=\d)"
NUM_STRICT = rf"{NUM_COMMAS}(?:\.\d+)?"

# Vendor-specific document number form (a parameter of the number operators).
VENDOR_NUMBER = r"(Mensa/[A-Z]{2}/[A-Z]{3}/\d+)"

DOC_TYPES = ["Tax Invoice", "Delivery Challan", "Stock Transfer"]
DOC_TYPES_MINIMAL = ["Tax Invoice", "Delivery Challan"]
DEFAULT_DOC_TYPE = "Tax Invoice"

# --- simple profile ------------------------------------------------------------
SIMPLE_NUMBER = [
    rf"Document\s*No\s*:?\s*({DOCNO})",
    rf"Invoice\s*No\.?\s*:?\s*({DOCNO})",
    rf"Invoice\s*Number\s*:?\s*({DOCNO})",
    rf"Bill\s*No\.?\s*:?\s*({DOCNO})",
]
SIMPLE_NUMBER_WORDS = ["Document", "Invoice", "Invoice", "Bill"]  # each pattern's first word
SIMPLE_NUMBER_DEFAULT = "UNKNOWN"
SIMPLE_DATE = [
    rf"Invoice\s*Date\s*:\s*({DATE_NUM})",
    rf"Date\s*:\s*({DATE_NUM})",
    rf"Date\s*:\s*({DATE_MON})",
    rf"Invoice\s*Date\s*:?\s*({DATE_MON})",
]
ANY_DATE = rf"({DATE_NUM})"

SUPPLIER_KEYWORDS = ["Supplier", "Seller", "From"]
BUYER_KEYWORDS = ["Buyer", "Bill to", "Customer", "Receiver"]
CONSIGNEE_KEYWORDS = ["Consignee", "Ship to"]
SECTION_TAIL = r".*?(?:GSTIN|PAN|\n\s*\n)"
SECTION_NAME = r"(?:Legal|Trade)?\s*Name\s*:?\s*([^\n]+)"
SECTION_ADDRESS = r"Address\s*(?:1|2|Line)?\s*:?\s*([^\n]+)"
TAX_LINE = r"GSTIN|GST No|PAN"
LEGAL_NAME = r"Legal\s*Name\s*:?\s*([^\n]+)"
COMPANY_WORDS = ["PRIVATE", "LIMITED", "PVT", "LTD"]

SUPPLIER_ID_LABELS = [rf"Supplier\s*GSTIN\s*:?\s*({TAXID})", rf"Seller\s*GSTIN\s*:?\s*({TAXID})",
                      rf"From\s*GSTIN\s*:?\s*({TAXID})"]
BUYER_ID_LABELS = [rf"Buyer\s*GSTIN\s*:?\s*({TAXID})", rf"Customer\s*GSTIN\s*:?\s*({TAXID})",
                   rf"GST\s*No\.?:?\s*({TAXID})", rf"Consignee\s*GSTIN\s*:?\s*({TAXID})"]
GENERIC_ID_LABEL = rf"GSTIN\s*:?\s*({TAXID})"
# By role: the labels of an id, the role's words, and its place among all ids of the text (else the first).
SIMPLE_ID_ROLES = {"supplier": (SUPPLIER_ID_LABELS, "Supplier|Seller|From", 0),
                   "buyer": (BUYER_ID_LABELS, "Buyer|Customer|Bill to", 1),
                   "consignee": (BUYER_ID_LABELS, "Consignee|Ship to", 2)}

# The first number after the label, however far away.
SIMPLE_TOTAL_QTY = r"Total\s*(?:Qty|Quantity)"
SIMPLE_SUBTOTAL = one_of([r"Sub\s*Total", r"Taxable\s*Value", r"Assessable\s*Value"])
SIMPLE_TAXES = {"cgst_amount": "CGST", "sgst_amount": "SGST", "igst_amount": "IGST", "cess_amount": "CESS"}
SIMPLE_NUMBER_TAIL = r"[^0-9]*(\d[\d,.]*)"
TOTAL_LABELS = [r"Total\s*Invoice\s*Value\s*(?:in\s*INR)?", r"Total\s*Amount", r"Grand\s*Total",
                r"Total\s*Value", r"Total"]
SIMPLE_TOTAL_DECIMAL = [rf"{lab}\s*:?\s*(?:₹|Rs\.?)?\s*(\d[\d,.]+\.\d+)" for lab in TOTAL_LABELS]
SIMPLE_TOTAL_LOOSE = [rf"{lab}\s*:?\s*(?:₹|Rs\.?)?\s*(\d[\d,.]+)" for lab in TOTAL_LABELS]
WORDS_HINT = r"(?:Rupees|INR)\s*(?:in\s*Words)?:?\s*(.+?)(?:Only|only|\.|\n)"
WORDS_HINT_TOKENS = ["lakh", "lac"]
WORDS_HINT_VALUE = 100000.0

IRN = r"IRN\s*:?\s*([a-fA-F0-9]{64})"
EWAY = r"e[-\s]?way\s*bill\s*no\.?:?\s*(\d+)"
SIMPLE_WORDS = [one_of([r"Amount\s*(?:in|In)\s*Words", r"Total\s*in\s*words"]) + r"\s*:\s*(.*?)(?:\n|$)",
                r"(?:Rupees|Rs\.?)\s*(.*?)(?:Only|only)(?:\n|$)"]

# --- layout profile ---------------------------------------------------------------
LAYOUT_NUMBER = [rf"Invoice\s*No\.?\s*:\s*({DOCNO})", rf"Invoice\s*Number\s*:\s*({DOCNO})",
                 rf"Bill\s*No\.?\s*:\s*({DOCNO})"]
LAYOUT_NUMBER_WORDS = ["Invoice", "Invoice", "Bill"]  # each pattern's first word
LAYOUT_DATE = SIMPLE_DATE + [ANY_DATE]
LAYOUT_SUPPLIER_ROLES = ["Supplier", "Seller", "From", "Sold by"]
LAYOUT_BUYER_ROLES = ["Buyer", "Bill to", "Customer", "Billed to"]
LAYOUT_CONSIGNEE_ROLES = ["Consignee", "Ship to", "Delivered to"]
ENTITY_TAIL = r"\s*:\s*(.*?)(?:\n|GSTIN|PAN|$)"
# Role words that anchor the layout tax-id search, by role.
LAYOUT_ID_ROLES = {"supplier": "Supplier|Seller|From", "buyer": "Buyer|Customer|Bill to",
                   "consignee": "Consignee|Ship to"}
ADDRESS_LABEL = r"Address\s*:\s*(.*?)(?:GSTIN|PAN|Phone|Email|$)"
# From the first line end on: up to the end of the paragraph or line that follows the first such word.
ADDRESS_WORDS = [
    r"(?:Road|Street|Avenue|Lane|Boulevard|Drive|Place|Highway|Expressway|Freeway)",
    r"(?:Village|Town|City|District|State|Country)",
    r"(?:\d{6})",
]
ADDRESS_END = r"(?:\n\s*\n|\n[A-Z])"
ADDRESS_SKIP = r"GSTIN|PAN|Phone|Email"
LAYOUT_TOTAL_QTY = one_of(["Total Qty", "Quantity"])
LAYOUT_SUBTOTAL = SIMPLE_SUBTOTAL
LAYOUT_TOTAL = one_of([r"Total\s*Amount", r"Grand\s*Total", r"Invoice\s*Value"])
LAYOUT_NUMBER_TAIL = rf".*?(?:Rs\.?|INR)?\s*({NUM_STRICT})"
LAYOUT_TAX_LABELS = {"cgst_amount": "CGST", "sgst_amount": "SGST", "igst_amount": "IGST", "cess_amount": "CESS"}
LAYOUT_WORDS = [r"Amount\s*(?:in|In)\s*Words\s*:\s*(.*?)(?:\n|$)",
                r"(?:Rupees|Rs\.?)\s*(.*?)(?:Only|only)(?:\n|$)",
                r"Total\s*in\s*words\s*:\s*(.*?)(?:\n|$)"]
LAYOUT_IRN = r"IRN\s*:?\s*([a-fA-F0-9]{64})"

# --- minimal profile (fallback inside the model profile) --------------------------
MINIMAL_NUMBER = [rf"Invoice\s*No\.?\s*:?\s*({DOCNO})", rf"Document\s*No\s*:?\s*({DOCNO})", VENDOR_NUMBER]
MINIMAL_DATE = [rf"Invoice\s*Date\s*:\s*({DATE_NUM})", rf"Date\s*:\s*({DATE_NUM})",
                rf"Date\s*:\s*({DATE_MON})", rf"Date\s*of\s*Supply\s*:\s*({DATE_NUM})"]
MINIMAL_BUYER = [r"(?:Buyer|Bill To|Customer|Ship To|Billed To)\s*:\s*([^\n]+)",
                 r"(?:Buyer|Bill To|Customer|Ship To|Billed To)\s*Name\s*:\s*([^\n]+)",
                 r"Details\s*of\s*Receiver\s*[^:]*:\s*([^\n]+)"]
KNOWN_PARTIES = ["Myntra", "Jabong", "India Pvt Ltd"]
KNOWN_PARTY_FULL = r"(Myntra\s*Jabong\s*India\s*Pvt\s*Ltd)"
KNOWN_ADDRESS = r"(SVS\s*Warehouse[^\n]+\n[^\n][\s\S]*?)(?=\n\n|\z)"  # up to a blank line
MINIMAL_TOTAL = [rf"{lab}\s*:?\s*(?:₹|Rs\.?)?\s*(\d[\d,.]+\.\d+)" for lab in
                 [r"Total\s*Invoice\s*Value\s*(?:in\s*INR)?", r"Grand\s*Total", r"Total\s*Amount", r"Total"]]
MINIMAL_REMARK = "Extracted with fallback method due to {provider} API failure"
EMPTY_TEXT_REMARK = "Failed to extract text from PDF"
