"""They must equal those of the systems whose documents are read."""

CANONICAL = ["itemName", "pack", "batchNo", "expiryDate", "quantity", "freeQuantity", "discountPercent", "rate", "mrp", "hsnCode", "amount", "taxableAmount", "gstPercent", "cgstPercent", "sgstPercent", "netAmount", "company"]

# fixed values: header texts of each canonical field, in order of precedence
HEADER_ALIASES = {
    "itemName": ["product name", "item description", "particulars", "product nmae", "item name", "product", "description", "item", "product/item", "item/product"],
    "pack": ["pack", "packing", "packs", "pack size", "packsize", "packing size", "pkg", "pk", "unit", "uom"],
    "batchNo": ["batch", "batch no", "batchno", "batch no.", "batch number", "lot", "lot no", "lot no.", "lot.no", "batch/lot", "b.no", "b.no."],
    "expiryDate": ["exp", "expiry", "exp date", "exp.", "e.x.p", "ex", "ex...", "expiry date", "exp.date", "val date", "validity"],
    "quantity": ["qty", "quantity", "billed qty", "billed", "units", "bld qty", "qty.", "quantity billed", "qty+free", "qty/free", "nos", "no", "nos.", "no."],
    "freeQuantity": ["free", "free qty", "sch qty", "scheme qty", "f.qty", "free quantity", "bonus", "sch.qty"],
    "discountPercent": ["dis", "disc", "disc.", "sch", "scheme", "idisper", "dis%", "disc%", "discount %", "discount", "discount%", "sch%", "scheme%"],
    "rate": ["rate", "rat e", "ptr", "pur rate", "purchase rate", "Rate ", "p.t.r", "rate/unit", "pur. rate", "p.t.r.", "unit rate", "net rate", "price to retailer"],
    "mrp": ["mrp", "m.r.p", "max retail price", "M.R.P", "M R P", "m r p", "m.r.p.", "old mrp", "old m.r.p", "maximum retail price", "mrp rs"],
    "hsnCode": ["hsn", "hsn/sac", "hsn code", "hsncode", "sac code", "hsn/sac code", "hsn code/sac", "hsn/saccode", "hsn/sc", "hsn code/sac code"],
    "amount": ["amount", "gross amt", "gross amount", "total", "item amt", "amt", "value", "gross value"],
    "taxableAmount": ["taxable", "taxable amt", "taxable value", "taxable amount", "taxable val", "taxable val."],
    "netAmount": ["net", "net amount", "net value", "net amt", "bill amt", "net payable", "net pay", "invoice amt"],
    "cgstPercent": ["cgst", "cgst%", "cgst per", "cgstper", "cgst rate", "c.gst", "c.gst%"],
    "sgstPercent": ["sgst", "sgst%", "sgst per", "sgstper", "sgst rate", "s.gst", "s.gst%", "utgst", "utgst%"],
    "gstPercent": ["gst", "gst%", "gst rate", "total gst", "igst", "tax%", "tax", "tax rate", "vat%"],
    "company": ["mfr", "mfg", "mkt by", "mfname", "mfgby", "company", "mfac mkt by", "mfac/ mkt by", "mfac/", "manufacturer", "mfg.by", "mfr."],
}

# fixed values: words that repeated headers hold
REPEATED_HEADERS = ["item description", "product name", "product nmae", "m.r.p", "mrp", "quantity", "billed free", "pack batch", "hsn /sac", "old mrp", "mfac/ mkt", "exp date"]

# fixed values: headings that number rows
SERIAL_HEADERS = ["s", "sn", "sno", "slno", "srno"]

# fixed values: GST slabs, in percent
GST_SLABS = [0, 5, 12, 18, 28]

# fixed values: HSN chapters of pharmaceutical goods
PHARMA_CHAPTERS = ["2106", "3001", "3002", "3003", "3004", "3005", "3006", "3304", "3305", "3306", "3401", "3808", "3822", "9018", "9019", "9021"]

# fixed values: month abbreviations
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]

# fixed values: dosage forms and pack counts, dropped from product names (regular expression)
DOSAGE_NOISE = (
    r"\b(tablets?|tabs?|capsules?|caps?|syrups?|syp|injections?|inj|drops?|"
    r"ointments?|oint|gels?|creams?|suspensions?|susp|solutions?|soln|lotions?|"
    r"respules?|rotacaps?|inhalers?|mouthwash|spray|powder|infusion|vials?|ampoules?|amps?|"
    r"duo|sr|mr|cr|er|xl|ds|forte|plus|md|dt|"
    r"\d+\s*['x\*]\s*\d+s?|\d+['’]s|\d+s|\d+\s*(?:gm|ml|ltr|g)\b|"
    r"strip|strips|bottle|bottles|tube|tubes|pack|blister)\b"
)

# fixed values: running totals, page totals and page marks (regular expressions, lower case)
RUNNING_TOTAL = r"\b(total\s*b/?f|b/?f\s*total|b\.?f\.?|brought\s*forward|amt\s*b/?f|b/?f\s*amt|total\s*c/?f|c/?f\s*total|c\.?f\.?|carried\s*forward|amt\s*c/?f|balance\s*c/?f|bal\s*c/?f)\b"
PAGE_TOTAL = r"\b(page\s*total|page\s*\d+\s*total|sub\s*total|sub-total|page\s*subtotal|total\s*carried|total\s*b/f\s*from|balance\s*b/f)\b"
PAGE_MARK = r"\b(page\s*\d+\s*of\s*\d+|page\s*\d+\s*/\s*\d+|continued\s*on\s*next\s*page|contd\.?|\(contd\.?\)|continued\.\.\.)\b"

# fixed values: phrases of footers and of letterheads
FOOTER = ["remark:", "bank name", "amount in words", "continued", "continue", "contd", "cont.", "sub total", "subtotal", "grand total", "tax%", "declaration", "tot items", "total items", "total qty", "mr value", "mrp value", "total tax amt", "rupees", "rs.", "ifsc", "terms", "condition", "authorised signatory", "authorized signatory", "taxable amt", "taxable value", "outstanding", "for oustanding", "picked by", "checked by", "packed by", "delivery by", "created by", "pkd by", "class total", "disc taxable", "**grb", "no grb", "fridge products", "from 5th to"]
LETTERHEAD = ["logistics", "pharma hub", "gst invoice", "tax inv.no", "tax inv no", "page 2", "page 1", "page no", "page of", "d.l.no", "dl no", "d.l no", "credit", "sales executive", "original for recipient", "invoice date", "due date", "order no", "ref id", "route nam", "gstin:", "gstin ", "phone:", "email id", "udyam", "whatsapp", "authorised", "authorized"]

# fixed values: phrases that open a section of a document
RETURN_SECTION = ["returns adjusted", "return adjusted", "credit note", "cr note", "cr/dr no", "return items", "expiry return", "breakage return", "sales return", "goods returned"]
SCHEME_SECTION = ["scheme items", "bonus items", "free items", "promotional goods"]

# fixed values: GST rates of whole and half taxes, in percent
GST_RATES = [0.0, 0.25, 1.5, 2.5, 5.0, 6.0, 9.0, 12.0, 14.0, 18.0, 28.0]

# fixed values: first digits of HSN codes that pharmaceutical invoices carry
HSN_STARTS = ["30", "21", "38", "90", "33", "34", "29", "19", "40", "48"]

# fixed values: a pack size (regular expression)
PACK_SIZE = r"(?i)\b(\d+['`’]s|\d+\s*s|\d+x\d+|\d+\*\d+|\d+\s*(?:ml|gm|mg|tab|cap|vial|amp|btl|strip|box|ltr|kg))\b"

# fixed values: words that mark a product name
ITEM_WORDS = ["tab", "caps", "cap", "syp", "inj", "gel", "susp", "oint", "drops", "cream", "tablet", "capsule", "syrup", "injection", "ointment", "powder", "lotion", "solution", "emulsion", "pharma", "mg", "ml", "gm", "forte", "plus", "duo", "ds", "dry", "dt", "sr", "er", "cr", "xl", "xr", "mr", "resp", "inhaler"]

# fixed values: a product name that is a dosage form alone (regular expression)
FORM_ONLY = r"(?i)^(tabs?|caps?|cream|syp|syrup|inj|gel|drops?|ointment|softgel|susp)(\b.*)?$"

# fixed values: fields whose errors are critical, and those that hold money or percentages
CRITICAL_FIELDS = ["itemName", "quantity", "rate", "amount"]
FINANCIAL_FIELDS = ["rate", "mrp", "discountPercent", "taxableAmount", "cgstPercent", "sgstPercent", "gstPercent", "netAmount", "amount"]

# fixed values: (absolute, relative) tolerance of each numeric field
TOLERANCES = {
    "quantity": (0.01, 0.0),
    "freeQuantity": (0.01, 0.0),
    "discountPercent": (0.05, 0.01),
    "rate": (0.05, 0.005),
    "mrp": (0.05, 0.005),
    "amount": (0.10, 0.005),
    "taxableAmount": (0.10, 0.005),
    "netAmount": (0.10, 0.005),
    "cgstPercent": (0.10, 0.0),
    "sgstPercent": (0.10, 0.0),
    "gstPercent": (0.10, 0.0),
}

# fixed values: beginnings of headers that number rows, and words of torn and of composite headers
AUXILIARY_HEADERS = ["S.", "S.NO", "SR NO", "SL NO", "S NO", "SR.NO", "SR.", "SL.", "NO.", "INDEX"]
TORN_HEADERS = r"\b(PT\s+R|M\s+R\s*P|M\s*R\s+P|MR\s+P|RAT\s+E|P\s+A\s+CK|BAT\s+CH|EX\s+P)\b"
COMPOSITE_HEADERS = ["QTY FREE", "AMOUNT GST", "BATCH EXP", "MRP RATE", "CGST SGST", "PACK QTY"]

# fixed values: headers (cleaned) that no canonical field may have
EXCLUDED_HEADERS = ["disamt", "discamt", "discountamount", "schamt", "gstamt", "taxamt", "totaltaxamt", "gstamount", "cgstamt", "sgstamt", "taxamount", "rack", "location", "bin", "slot", "box", "boxs", "boxes", "outer", "case", "cases", "old", "oldmrp", "prevmrp"]

# fixed values: fields that a saved template may name but no column takes
LEGACY_FIELDS = ["itemCode", "igstPercent", "saleRate", "boxs", "old"]

# fixed values: how strongly a cleaned header claims a field, where several do
HEADER_PRIORITY = {
    "rate": {"rate": 1000, "ptr": 700, "pricetoretailer": 700, "purrate": 800, "purchaserate": 800, "unitrate": 800, "netrate": 500},
    "mrp": {"mrp": 1000, "maxretailprice": 1000, "maximumretailprice": 1000, "oldmrp": 100, "old": 100},
    "pack": {"pack": 1000, "packing": 1000, "packs": 1000, "packsize": 1000, "packingsize": 1000, "pkg": 1000, "pk": 1000, "unit": 500, "uom": 500, "size": 500, "boxs": 0, "boxes": 0, "box": 0},
    "quantity": {"billedqty": 1000, "quantitybilled": 1000, "billed": 1000, "qty": 950, "quantity": 950, "units": 950, "nos": 950, "rack": 0, "location": 0},
    "discountPercent": {"dis": 900, "disc": 900, "discount": 900, "sch": 900, "scheme": 900},
    "amount": {"amount": 1000, "grossamt": 1000, "grossamount": 1000, "grossvalue": 1000, "amt": 900, "total": 900, "itemamt": 900, "value": 900},
    "gstPercent": {"gstrate": 1000, "taxrate": 1000, "totalgst": 1000, "igst": 1000, "gst": 900, "tax": 900},
}

# fixed values: parts of a cleaned header that take its claim to a field away
HEADER_CONTRARY = {"discountPercent": ["amt", "amount"], "amount": ["gst", "tax", "dis"], "gstPercent": ["amt", "amount"]}

# fixed values: words of repeated headers
HEADER_PHRASES = ["item description", "product name", "m.r.p", "billed", "quantity"]
HEADER_COMPANIONS = ["rate", "mrp", "m.r.p", "pack", "batch", "hsn", "qty", "amount"]

# fixed values: phrases and patterns that no product row has
NOT_ITEM = ["item description", "product name", "m.r.p", "quantity", "particulars", "invoice date", "due date", "order no", "ref id", "route", "fridge products", "from 5th to", "within 30", "days only", "goods once sold"]
CONTACT = r"\b(gstin|pan\s*no|phone|email|udyam|whatsapp|pin-?\s*\d{3}|state code)\b"
SECTION_META = r"\b(credit note no|cr\s*no|ack date|bill time|bank details)\b"

# fixed values: units behind a quantity, and strengths in product names (regular expressions)
QUANTITY_UNIT = r"(?i)\s*(?:nos\.?|tab(?:let)?s?|caps?(?:ule)?s?|packs?|strips?|units?|['`’]s)\b.*$"
STRENGTH = r"(\d+)\s+(MG|GM|MCG|ML|IU|G|MG/ML)\b"
STRENGTH_UNIT = r"(?<=\d)(MG|GM|MCG|ML|IU|G)\b"

# fixed values: words that make a line likely to be a supplier's name
SUPPLIER_WORDS = ["medi", "medical", "medicare", "medihub", "pharma", "pharmaceutical", "pharmaceuticals", "logistics", "agencies", "agency", "distributors", "distributor", "distribution", "stockist", "stockists", "wholesaler", "wholesalers", "wholesale", "chemist", "chemists", "drugs", "drug", "healthcare", "health care", "enterprises", "enterprise", "trading", "traders", "stores", "mart", "medico", "medicos", "life sciences", "biosciences", "formulations", "remedies", "therapeutics", "wellness", "pharma hub", "medplus", "apollo", "retail", "suppliers", "supplier", "pvt", "private limited", "ltd", "llp", "opc"]

# fixed values: labels, titles and buyers, which are no supplier's name, and marks of addresses (regular expressions)
NOT_SUPPLIER = r"(?i)pharma\s*hubb\b|bill\s*to|ship\s*to|sold\s*to|consignee|buyer|customer|party\s*name|gst\s*invoice|tax\s*invoice|original\s*for\s*recipient|^page\s*\d|^invoice\s*(no|number|date)|^date\s*:|^gstin|^phone|^email|^mobile|^tel\.?|^dl\.?\s*no|^fssai|^due\s*date|^credit|^debit|^irn\b|^ack\b|^einvoice|^e-?invoice|^taxable|^hsn|^particulars|^description|^s\.?\s*no|^qty\b|^mrp\b|^rate\b|^amount\b|^net\s*amount|^grand\s*total|^authori[sz]ed\s*sign|\bmfgby\b|\bhsncode\b|\bproduct\s*name\b|\bbatch\s*no\b|\bc/s\s*qty\b"
PLACE = r"(?i)\b(plot|street|road|road\.|rd\.|floor|flr|nagar|colony|sector|phase|block|building|bldg|near|opp\.?|beside|pin\s*:?|pincode|dist\.?|district|state|india)\b|@|www\.|http|\+?\d[\d\s-]{8,}"
PIN = r"\b\d{6}\b"
ADDRESS = f"{PLACE}|{PIN}"
BARCODE_FONT = r"(?i)free\s*3\s*of\s*9|barcode|code\s*39|code128"
BOLD_FONT = r"(?i)bold|black|heavy|semibold|demi"
SELLER_CUT = r"(?i)\b(gst\s*invoice|tax\s*invoice|m/s\.?\s*pharma\s*hubb|m/s\.?\s*pharma|pharma\s*hubb|pharma\s*hub|original\s*for\s*recipient|inv\s*no|party\s*name|bill\s*to|ship\s*to)\b"

# fixed values: how invoices print their number, date and totals (regular expressions)
INVOICE_NUMBER = r"(?i)(?:inv(?:oice)?\s*\.?\s*no\s*\.?\s*[:-]?\s*)([A-Z0-9/-]+)"
INVOICE_DATE = r"(?i)(?:(?:inv(?:oice)?\s*\.?\s*)?d[a|t]te?\s*\.?\s*[:-]?\s*)(\d{2}[-/\.]\d{2}[-/\.]\d{2,4}|\d{2}-[A-Za-z]{3}-\d{2,4})"
ROUND_OFF = r"(?i)round\s*off\s*[:=]?\s*([+-]?\s*[\d,]+\.\d{2})"
TCS = r"(?i)\btcs\s*(?:amt|amount)?\s*[:=]?\s*[₹n]?\s*([\d,]+\.\d{2})"
SIX_TOTALS = r"(?i)\bTOTAL\s+([\d\.]+\s+[\d\.]+\s+[\d\.]+\s+[\d\.]+\s+[\d\.]+\s+[\d\.]+)"
GRAND_TOTAL = r"(?i)(?:grand\s*total|net\s*pay(?:able)?|bill\s*amount|total\s*payable|tot\s*net|net\s*total|invoice\s*total|grand\s*\/\s*net\s*total)\s*[:=]?\s*[₹n]?\s*([\d,]+\.\d{2})"
MESSAGE_TOTAL = r"(?i)message\s*:\s*rs\.?\s*([\d,]+(?:\.\d{2})?)"
NET_TOTAL = r"(?i)\bNet\s*:\s*([\d,]+\.\d{2})"
TAXABLE_TOTAL = r"(?i)(?:taxable\s*amt|taxable\s*value|taxable\s*amount|total\s*taxable|sub\s*total)\s*[:=]?\s*₹?\s*([\d,]+\.\d{2})"
GST_TOTAL = r"(?i)(?:total\s*tax\s*(?:amt)?|total\s*gst|gst\s*amount|tax\s*amount|gst\s*tax)\s*[:=]?\s*₹?\s*([\d,]+\.\d{2})"

# fixed values: dosage forms that name no product by themselves
FORM_WORDS = ["tab", "tabs", "cap", "caps", "cream", "gel", "syp", "inj", "ml", "gm", "mg"]

# fixed values: words of table headers, in letters, digits and the signs % . /
HEADER_VOCABULARY = [
    "sno", "s.no", "sr", "sr.no", "sn", "sl", "slno", "s", "item", "code", "mfg", "mfgby", "mfr", "make", "mfg.", "product", "productname", "description", "itemdescription", "particulars", "name", "pack", "packing", "pk", "pkg", "unit", "boxs", "case", "size",
    "hsn", "hsncode", "hsn/sac", "sac", "batch", "batchno", "batch.no", "lot", "b.no", "bno", "exp", "expiry", "exp.", "expdate", "e.x.p", "dt", "date", "mrp", "m.r.p", "m.r.p.", "ptr", "p.t.r", "p.t.r.", "pts", "p.t.s", "rate", "price", "unitprice", "pur.rate",
    "qty", "quantity", "billed", "free", "freeqty", "fr", "sch", "scheme", "f.qty", "b.qty", "disc", "disc%", "discount", "dis", "dis%", "sch%", "cd", "cd%", "td", "td%", "taxable", "taxableval", "taxablevalue", "taxableamt", "baseamt", "value",
    "gst", "gst%", "cgst", "cgst%", "sgst", "sgst%", "igst", "igst%", "tax", "tax%", "amount", "amt", "net", "netamt", "netamount", "total", "val", "gross", "old", "r.mar", "mktby", "rack",
]

# fixed values: marks of lines that are no table header (regular expressions)
META_KEY = r"(?i)\b(phone|ph|ph\.no|contact|email|dlno|dl|d\.l|d\.l\.no|lic|licence|license|foodlic|fssai|gstin|pan|irn|irnno|ack|ackno|ack\s*dt|cin|tan|invno|inv\s*no|invoice\s*no|inv\s*date|invoice\s*date|date|time|page|page\s*no|remby|repname|sales\s*man|sales\s*exec|salesman|route|veh|vehicle|order|po\s*no|cust|customer|buyer|consignee|patient|doctor|dr)\s*[:.]"
PAGE_NUMBER = r"(?i)(\bpage\s*(no|no\.)?\s*[:.]?\s*\d+\s*(of|/)\s*\d+|\bpage\s*[:.]?\s*\d+|\b\d+\s*/\s*\d+\b)"
PHONE_NUMBER = r"\b\d{10}\b|\b\d{3,5}[-\s]?\d{6,8}\b|\b\d{10}/\d{10}\b"
STREET_WORDS = r"(?i)\b(road|street|mandal|dist|floor|beside|near|opp|colony|nagar|bazar|market|complex|building|shop|pincode|state\s*code|state|telangana|andhra|hyderabad|mumbai|delhi|bangalore|chennai)\b"
SUBTOTAL_WORDS = r"(?i)\b(total|b/?f|c/?f|brought|carried|subtotal|balance|contd|continued)\b"
PAGE_END = ["bank", "terms", "condition", "signatory", "authorised", "authorized", "subtotal", "sub-total", "continue", "continued", "contd", "outstanding", "declaration"]
NUMERIC_FIELDS = ["rate", "mrp", "amount", "taxableAmount", "netAmount", "quantity", "freeQuantity", "discountPercent", "gstPercent", "hsnCode"]

# fixed values: header texts of each column of stated tables, in order of precedence
STATED_ALIASES = {
    "line_number": ["S.", "S.NO", "SR.", "SL", "SL.NO", "ITEM NO"],
    "billed_qty": ["QTY", "QUANTITY", "BILLED", "BILLED QTY", "B.QTY", "QTY.", "B QTY", "QTY+FREE PACK", "SALE QTY"],
    "free_qty": ["FREE", "SCHEME", "SCH", "F.QTY", "FREE QTY", "SCM", "FR.QTY", "F QTY"],
    "mfg": ["MFG", "MFGBY", "MFR", "MFAC", "MFAC/RACK", "MKT BY", "MFR.", "COMPANY"],
    "rack": ["RACK", "RACK NO", "RACK/NO", "SHELF"],
    "pack": ["PACK", "PKG", "BOXS", "PACKING", "UNIT", "PK"],
    "product_name": ["PRODUCT NAME", "ITEM DESCRIPTION", "DESCRIPTION", "PARTICULARS", "ITEM NAME", "PRODUCT", "ITEM"],
    "hsn_code": ["HSN", "HSNCODE", "HSN/SAC", "HSN CODE", "HSN NO", "SAC"],
    "batch_number": ["BATCH", "BATCH NO", "BATCH NO.", "B.NO", "B.NO.", "LOT", "LOT NO"],
    "expiry_date": ["EXP", "EXPIRY", "EXP DT", "EXP.DATE", "EXP. DT", "E.X.P", "EXP DATE", "EXPIRY DATE", "E.X", "EX"],
    "mrp": ["MRP", "M.R.P", "M.R.P.", "M. R. P."],
    "ptr": ["PTR", "P.T.R", "P.T.R.", ".P P.T", "P PT", "P.T"],
    "rate": ["RATE", "PUR.RATE", "P.RATE", "PRICE", "UNIT RATE", "P RATE", ".R RA", "R RA", "R.RA"],
    "discount": ["DISC", "DIS", "DIS%", "DISCOUNT", "SCH.DISC", "DIS.AMT", "LESS", "SCH DISC", "DIS AMT", "UNT D", "UNT.D"],
    "taxable_amount": ["AMOUNT", "TAXABLE", "TAXABLE AMT", "ASS.VAL", "ASS VAL", "AMT", "VALUE", "TAXABLE VALUE", "NET AMOUNT", "TE AMO", "TE.AMO"],
    "gst_rate": ["GST", "GST%", "GST RATE", "TAX%", "TAX RATE", "ISC GST", "ISCGST"],
    "cgst_rate": ["CGST%", "CGST %"],
    "sgst_rate": ["SGST%", "SGST %"],
    "cgst_amount": ["CGST", "CGST AMT", "CGST PAYBLE", "CGST AMOUNT"],
    "sgst_amount": ["SGST", "SGST AMT", "SGST PAYBLE", "SGST AMOUNT"],
    "igst_amount": ["IGST", "IGST AMT", "IGST AMOUNT"],
    "net_amount": ["NET", "NET AMOUNT", "NET VALUE", "TOTAL", "NET AMT", "NET VAL", "TOTAL VALUE"],
}

# fixed values: columns of which a stated table's header names two, GST rates as printed, and what lines of no goods say
STATED_ESSENTIALS = ["product_name", "billed_qty", "batch_number", "rate", "mrp", "taxable_amount"]
PRINTED_SLABS = ["5", "5.0", "5.00", "12", "12.0", "18", "18.0", "28", "28.0"]
NO_STATED_ITEM = ["MFAC/", "ITEM DESCRIPTION", "QUANTITY", "BILLED", "SUB TOTAL", "TAXABLE", "TOTAL BILLS", "AMOUNT IN WORDS", "ROUND OFF", "BANK NAME"]

# fixed values: labels of a stated document's figures (regular expressions)
STATED_GSTIN = r"\b\d{2}[A-Z]{5}\d{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}\b"
STATED_NUMBER = r"(?i)(?:Inv(?:oice)?\s*No\.?|Tax\s*Inv\.No\.?)\s*[:.-]?\s*([A-Za-z0-9\/-]+)"
STATED_DATE = r"(?i)(?:Inv(?:oice)?\s*Date|Date)\s*[:.-]?\s*(\d{1,2}[-\/][A-Za-z0-9]{2,3}[-\/]\d{2,4})"
STATED_TOTAL = r"(?i)(?:Grand\s*Total|NETAmount|Net\s*Amount|Net\s*Payable|Bill\s*Amount)\s*[:.-]?\s*(?:Rs\.?)?\s*([0-9,]+\.\d{2})"
STATED_ROUND_OFF = r"(?i)Round\s*off\s*[:.-]?\s*([0-9.-]+)"
STATED_TAX = r"(?i)(?:Total\s*Tax\s*Amt\.?|Total\s*GST)\s*[:.-]?\s*([0-9,]+\.\d{2})"

# fixed values: free quantities that are printed without their leading point
LOST_POINTS = [100, 200, 250, 300, 400, 500, 600, 700, 750, 800, 900]
