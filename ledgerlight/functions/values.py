"""Word lists, lookup tables and thresholds that results depend on."""

from __future__ import annotations

# Header names of exports, lower case, and the columns they become.
HEADERS = {
    "tran id": "tran_id",
    "transaction id": "tran_id",
    "filed date": "filed_date",
    "tran date": "tran_date",
    "date": "filed_date",
    "amount": "amount",
    "tran amount": "amount",
    "sub type": "sub_type",
    "subtype": "sub_type",
    "contributor/payee": "contributor_payee",
    "contributor": "contributor_payee",
    "payee": "contributor_payee",
    "contributor/payee name": "contributor_payee",
    "contributor type": "contributor_type",
    "filer": "filer",
    "committee": "filer",
    "filer name": "filer",
    "committee name": "filer",
    "office": "office",
    "office sought": "office",
    "party": "party",
    "purpose": "purpose",
    "purp desc": "purpose",
    "purpose codes": "purpose_codes",
    "occptn txt": "occupation",
    "emp name": "employer",
    "city": "city",
    "state": "state",
    "zip": "zip",
    "book type": "book_type",
}

# Transaction types, and the type of each sub-type.
TRAN_TYPES = ("C", "E", "O", "OA", "OD", "OR")
SUB_TYPES = {
    "C": [
        "Cash Contribution",
        "In-Kind Contribution",
        "In-Kind/Forgiven Personal Expenditures",
        "In-Kind/Forgiven Account Payable",
        "Loan Received (Non-Exempt)",
        "Pledge of Cash",
        "Pledge of In-Kind",
        "Pledge of Loan",
    ],
    "E": ["Cash Expenditure", "Account Payable", "Expenditure Made by an Agent", "Personal Expenditure for Reimbursement", "Loan Payment (Non-Exempt)"],
    "OR": ["Miscellaneous Other Receipt", "Refunds and Rebates", "Lost or Returned Check", "Interest/Investment Income", "Items Sold at Fair Market Value", "Loan Received (Exempt)"],
    "O": ["Account Payable Rescinded", "Cash Balance Adjustment", "Loan Forgiven (Non-Exempt)", "Personal Expenditure Balance Adjustment", "Uncollectible Pledge of Cash", "Uncollectible Pledge of In-Kind"],
    "OA": ["Miscellaneous Account Receivable", "Unexpended Agent Balance"],
    "OD": ["Miscellaneous Other Disbursement", "Return or Refund of Contribution", "Nonpartisan Activity", "Loan Payment (Exempt)"],
}
IN_KIND = ("In-Kind Contribution", "In-Kind/Forgiven Account Payable", "In-Kind/Forgiven Personal Expenditures")
REFUND = "Return or Refund of Contribution"
BALANCE_ADJUSTMENT = "Cash Balance Adjustment"
STATEMENT_CONTRIBUTIONS = ("Cash Contribution", "Loan Received (Non-Exempt)", *IN_KIND)
STATEMENT_EXPENDITURES = ("Cash Expenditure", "Loan Payment (Non-Exempt)")
CASH_CONTRIBUTIONS = ("Cash Contribution", "Loan Received (Non-Exempt)")
CASH_EXPENDITURES = ("Cash Expenditure", "Loan Payment (Non-Exempt)")

# Pooled labels.
POOLED = "Miscellaneous Cash Contributions $100 and under"
POOLED_REFUND = "Miscellaneous Return/Refund of Contribution $100 and under"

# Words of names.
TITLE_FIXES = [
    (r"\bllc\b", "LLC"),
    (r"\binc\.?", "Inc"),
    (r"\bcorp\.?", "Corp"),
    (r"\bpac\b", "PAC"),
    (r"\bltd\.?", "Ltd"),
    (r"\bco\.?\b", "Co"),
    (r"\bassn\.?", "Assn"),
    (r"\bassoc\.?", "Assoc"),
    (r"\bcommittee\b", "Committee"),
    (r"\bfor\b", "for"),
    (r"\band\b", "and"),
    (r"\bof\b", "of"),
    (r"\bthe\b", "the"),
]
CONTRIBUTOR_TYPES = {
    "I": "Individual",
    "B": "Business / Corporation",
    "L": "Labor Organization",
    "P": "Political Action Committee",
    "F": "Political Party",
    "C": "Candidate & Family",
    "U": "Unregistered Committee",
    "O": "Other",
}
INDIVIDUALS = ("Individual", "Candidate & Immediate Family")
COMMITTEES = ("Political Committee", "Political Party Committee", "Unregistered Committee")
COMMITTEE_NAME = (
    r"(?i)\bpac\b|\bp\.a\.c\b|committee|friends of|citizens for|neighbors for|"
    r"\bfor (senate|house|congress|governor|mayor|city council|state rep|county commissioner|district attorney|sheriff|judge|treasurer|oregon)\b|"
    r"\(\d{2,6}\)\s*$"
)
EMBEDDED_ID = r"\((\d{2,6})\)\s*$"
NOT_GIVEN_NAMES = (
    "inc", "llc", "corp", "co", "ltd", "lp", "llp", "pc", "plc", "pllc", "company", "incorporated", "corporation", "limited", "sa", "nv", "ag",
    "gmbh", "pa", "psc", "trust", "foundation", "fund", "and sons", "sons",
    "jr", "sr", "ii", "iii", "iv", "v", "md", "phd", "esq", "dds", "cpa", "rn", "do", "dc", "od", "dvm", "jd", "mba", "pe", "aia", "ret",
)
STREET_WORDS = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "lane": "ln", "court": "ct", "place": "pl", "highway": "hwy",
    "parkway": "pkwy", "circle": "cir", "terrace": "ter", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw", "north": "n",
    "south": "s", "east": "e", "west": "w", "apartment": "", "suite": "", "unit": "", "ste": "", "apt": "",
}
NO_EMPLOYER = ("", "none", "n a", "na", "not employed", "retired", "self", "self employed", "unemployed")
NULL_WORDS = ("nan", "none", "nat", "<na>", "null")
HONORIFICS = (
    "dr", "mr", "mrs", "ms", "miss", "rev", "hon", "sen", "rep", "gov", "jr", "sr", "ii", "iii", "iv", "vi", "md", "phd", "dds", "esq", "cpa", "rn",
)
NICKNAMES = {
    "rob": "robert", "bob": "robert", "bobby": "robert", "deb": "deborah", "debbie": "deborah", "rich": "richard", "rick": "richard", "dick": "richard",
    "bill": "william", "will": "william", "billy": "william", "jim": "james", "jimmy": "james", "mike": "michael", "dan": "daniel", "danny": "daniel",
    "dave": "david", "tom": "thomas", "tommy": "thomas", "chris": "christopher", "kim": "kimberly", "ben": "benjamin", "ed": "edward", "eddie": "edward",
    "jeff": "jeffrey", "sue": "susan", "susie": "susan", "liz": "elizabeth", "beth": "elizabeth", "matt": "matthew", "nick": "nicholas", "tony": "anthony",
    "pat": "patricia", "patty": "patricia", "greg": "gregory", "steve": "steven", "stephen": "steven", "joe": "joseph", "tim": "timothy", "ron": "ronald",
    "don": "donald", "ken": "kenneth", "andy": "andrew", "drew": "andrew", "sam": "samuel", "charlie": "charles", "chuck": "charles",
    "kate": "katherine", "kathy": "katherine", "cathy": "catherine", "jen": "jennifer", "jenny": "jennifer", "becky": "rebecca", "peggy": "margaret", "meg": "margaret",
}
COMMITTEE_TAILS = (" pac", " committee", " cmte", " comm", " political action committee", " for oregon", " for or")

# Consumer prices, all urban consumers, annual averages (1982-84 = 100); from 2025 estimates.
CPI = {2006: 201.6, 2008: 215.303, 2010: 218.056, 2012: 229.594, 2014: 236.736, 2016: 240.007, 2018: 251.107, 2020: 258.811, 2022: 292.655, 2024: 313.689, 2026: 327.0}
CPI_BASE = 2024

# Fields of an annual statement, and those of them whose unknown stays unknown in a sum.
STATEMENT_FIELDS = (
    "ending_cash_balance", "beginning_balance", "contributions", "expenditures", "other_receipts", "other_disbursements", "balance_adjustments",
    "inkind_contributions", "inkind_expenditures", "loans_received", "loans_received_exempt", "loan_payments", "loan_payments_exempt",
    "accounts_receivable", "accounts_payable", "total_outstanding_loans", "outstanding_personal_expenditures", "balance_deficit",
)
UNKNOWN_STAYS = STATEMENT_FIELDS[7:]

# Amount bands of an over-full window.
AMOUNT_BANDS = [
    (None, "9.99"), ("10", "14.99"), ("15", "15.99"), ("16", "19.99"), ("20", "24.99"), ("25", "49.99"),
    ("50", "99.99"), ("100", "249.99"), ("250", "999.99"), ("1000", "4999.99"), ("5000", None),
]

# Browse.
SORTS = ("tran_date", "filed_date", "amount", "filer", "contributor_payee", "tran_type", "sub_type")
PAGE_MOST, SQL_ROWS, EXPORT_ROWS, REVIEW_ROWS = 1000, 5000, 50_000, 2000
WRITING_WORDS = "insert|update|delete|drop|alter|create|grant|revoke|truncate|copy|call|do|vacuum|analyze"
