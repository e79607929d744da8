"""Corpus jobs: text to lines, key-values, types, numbers, amounts, dates and table rows.

A document's text is one cell, so its lines are kept as an array inside the row and
worked on with higher-order functions: classification, extraction and table reading
need no explode, no join and no shuffle. Vocabularies are fixed literals.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bizdocs.functions import numbers as N
from bizdocs.functions.dates import extract_date, repair_date
from bizdocs.functions.lines import cut_lines, text_lines
from bizdocs.functions.markup import csv_text, json_lines, unescape, xml_text
from bizdocs.functions.text import collapse, found, let, matches, normalize_label
from bizdocs.operators.line_items import looks_like_header

# --- fixed values -------------------------------------------------------------
TYPE_WORDS = [
    ("delivery_note", ["납품서", "납품번호", "납품일", "납품수량", "입고장소", "수령자", "delivery note"], r"(?i)\bDN[-_ ]?\d{4}|납품서|납품번호", 8),
    ("invoice", ["세금계산서", "계산서번호", "인보이스번호", "청구서번호", "청구금액", "지급기한", "결제기한", "사업자등록번호", "공급받는자", "invoice"], r"(?i)\bINV[-_ ]?(?:[A-Z0-9]+[-_ ]?)*\d{4}|계산서번호|세금계산서|invoice", 8),
    ("quotation", ["견적서", "견적번호", "견적일", "유효기간", "견적유효기간", "납기조건", "결제조건", "quotation", "quote"], r"(?i)\bQT[-_ ]?\d{4}|견적서|견적번호", 8),
    ("purchase_order", ["발주서", "발주번호", "발주처", "납기일", "purchase order", "po no"], r"(?i)\b(?:PO|FAXx?-PO|FAX-PO)[-_ ]?\d{4}|발주서|발주번호", 8),
    ("transaction_statement", ["거래명세서", "거래명세서번호", "거래일자", "transaction statement"], r"(?i)\bTS[-_ ]?\d{4}|거래명세서", 8),
    ("inspection_report", ["입고검사성적서", "입고 검사 기록서", "입고검사기록서", "입고검사", "검사성적서", "검사번호", "입고수량", "합격수량", "불량수량", "inspection report"], r"(?i)\b(?:IQC|QC)[-_ ]?\d{4}|입고검사|검사번호|합격수량", 10),
]
HANDWRITTEN_TYPES = [
    ("inspection_report", "(간이검사기록|입고확인|검사수량|치수이상없음|수량확인완료)"), ("transaction_statement", "(거래멈세서|거래명세서|거래명세)"),
    ("delivery_note", "(납품서|납품메모)"), ("memo", "(발주메모|주문목록|구매메모)"), ("general_document", "(자재리스트|자재목록|구매요청|현장.*공장)"),
]
NUMBERED_TYPES = [
    ("invoice", r"(?i)\bINV[-_ ]?(?:[A-Z0-9]+[-_ ]?)*\d{4}|\b(?:invoice|tax)\s*(?:no|number)"), ("quotation", r"(?i)\bQT[-_ ]?\d{4}|\b(?:quotation|quote)\s*(?:no|number)"),
    ("purchase_order", r"(?i)\bPO[-_ ]?\d{4}|\b(?:po|purchase\s+order)\s*(?:no|number)"), ("delivery_note", r"(?i)\bDN[-_ ]?\d{4}|\bdelivery\s+note\s*(?:no|number)"),
    ("transaction_statement", r"(?i)\bTS[-_ ]?\d{4}|\btransaction\s+statement\s*(?:no|number)"),
    ("packing_list", "포장명세서|packing list"), ("inspection_report", "검사성적서|inspection report"), ("contract", "계약서|contract"), ("invoice", "세금계산서|invoice|청구서"),
]
FALLBACK_WORDS = [
    ("document", 2, ["invoice", "invoice number", "invoice #", "vendor", "bill to", "amount due", "total due"]),
    ("document", 2, ["installation guide", "setup guide", "technical guide", "project setup", "install", "configuration", "environment variables", "dependencies"]),
    ("document", 3, ["implementation schedule", "project tracker", "roadmap", "task", "feature", "status", "testing", "coverage", "pipeline", "claimed"]),
    ("presentation", 2, ["presentation", "slide", "speaker notes", "speaking notes", "talk track", "rehearse", "script"]),
    ("receipt", 2, ["receipt", "subtotal", "total", "tax", "change", "visa", "영수증", "영수증번호", "감사합니다"]),
    ("notice", 1, ["notice", "announcement", "effective date", "deadline", "meeting"]),
    ("memo", 1, ["memo", "note", "reminder", "todo"]),
]
PROFILE_SIGNATURES = {
    "purchase_memo": [r"발주\s*메모", r"구매\s*메모", r"구매\s*요청\s*메모", r"purchase\s+memo", r"handwritten-like\s+purchase\s+memo", r"단가\s*확인\s*필요", r"자재\s*입고\s*요청", r"\bPM[-_ ]?\d{4}"],
    "pos_daily_settlement": [r"POS\s*일일\s*정산", r"POS\s*메인", r"일\s*정산", r"매출\s*정산", r"daily\s+sales\s+settlement", "실판매금액", "순판매금액", "총판매금액", "카드합계", "현금합계", "온라인결제", r"\bPOS[-_ ]?\d{4}"],
    "receipt": ["영수증번호", "영수증", r"\bRC[-_ ]?\d{4}", r"\breceipt\b", "감사합니다"],
    "internal_transfer": [r"자재\s*이동\s*요청서", r"internal\s+transfer", "출고창고", "입고창고", "이동사유", r"금액\s*/?\s*세액\s*없음", r"\b(?:TRF|MV)[-_ ]?\d{4}"],
}
FORMAL_TITLE = r"(?i)(세금\s*계산서|tax\s+invoice|거래\s*명세서|transaction\s+statement|발주서|purchase\s+order|견적서|quotation|납품서|delivery\s+note|입고\s*검사|inspection\s+report)"
RECEIPT_SIGNAL = r"(?i)(영수증\s*번호|\bRC[-_ ]?\d{4}\b|^\s*영수증\s*$|감사합니다|\breceipt\b)"
RETURN_WORDS = r"(?i)\b(?:RTN|RCM)[-_ ]?\d{4}|반품\s*/?\s*(?:차감|크레딧)|반품\s*요청|차감\s*요청|크레딧\s*메모|반품전표|차감전표|return\s+note|credit\s+note|credit\s+memo|deduction"
CREDIT_WORDS = r"(?i)credit\s+note|credit\s+memo|deduction|차감|크레딧"
TRANSFER_WORDS = r"(?i)\bTRF[-_ ]?\d{4}|사업장\s*간|자재\s*이동|내부\s*(?:자재\s*)?이동|창고\s*이동|지점\s*이동|internal\s+transfer|branch\s+transfer|transfer\s+slip"
POS_WORDS = r"(?i)\bPOS[-_ ]?\d{4}|POS\s*메인|POS\s*일\s*정산|일\s*정산|매출\s*정산|순\s*판매\s*금액|실\s*판매\s*금액|총\s*판매\s*금액|카드\s*합계|현금\s*합계|온라인\s*결제"
MEMO_WORDS = r"(?i)\bPM[-_ ]?\d{4}|구매\s*메모|발주\s*메모|purchase\s+memo|단가\s*확인\s*필요|자재\s*입고\s*요청"
DOLLAR_WORDS = r"(?i)commercial\s+invoice|proforma\s+invoice|\bUSD\b|US\$|\$"
COMMERCIAL_WORDS = r"(?i)commercial\s+invoice|\bINV[-_ ]?US[-_ ]?\d{4}|\bUSD\b|US\$|\$"
EVIDENCE = {
    "internal_transfer": [r"\bTRF[-_ ]?\d{4}", r"사업장\s*간", r"자재\s*이동", r"내부\s*(?:자재\s*)?이동", "내부품목코드", "요청수량|요청수림", r"internal\s+transfer|branch\s+transfer|transfer\s+slip"],
    "return": [r"\b(?:RTN|RCM)[-_ ]?\d{4}", "반품", "차감", "크레딧", r"credit\s+note|credit\s+memo", r"return\s+note|return\s+authorization", r"관련\s*납품서|원\s*납품서|related\s+(?:delivery|document)"],
    "pos": [r"\bPOS[-_ ]?\d{4}", r"POS\s*메인", r"일\s*정산", r"매출\s*정산", r"순\s*판매\s*금액|실\s*판매\s*금액|총\s*판매\s*금액", r"카드\s*합계|현금\s*합계|온라인\s*결제"],
    "memo": [r"\bPM[-_ ]?\d{4}", r"구매\s*메모|발주\s*메모|purchase\s+memo", r"단가\s*확인\s*필요", r"자재\s*입고\s*요청"],
    "tax": [r"전자\s*세금계산서|세금계산서", "사업자등록번호", "공급받는자", "승인번호", "작성일자", "공급가액", "부가세|세액"],
    "commercial": [r"commercial\s+invoice", r"\bINV[-_ ]?US[-_ ]?\d{4}", r"\bUSD\b|US\$|\$"],
}
SEMANTIC_TYPES = [
    ("pos_daily_settlement", "general_document", r"POS\s*일일정산|실판매금액|결제합계|카드합계|온라인결제"), ("internal_transfer", "general_document", r"자재\s*이동|내부\s*이동|출고창고|입고창고|이동사유"),
    ("incoming_inspection", "inspection_report", r"입고\s*검사|검사판정|검사항목|Lot/Code|Lot\s*No"), ("tax_invoice", "invoice", r"세금\s*계산서|전자\s*세금\s*계산서|Tax\s*Invoice|승인번호"),
    ("commercial_invoice", "invoice", r"COMMERCIAL\s+INVOICE|Exchange\s*Rate|TOTAL\s*USD|KRW\s*Converted"), ("credit_note", "general_document", r"반품|크레[딧뒷]|Credit\s*(?:Memo|Note)|원문서|차감\s*합계"),
    ("transaction_statement", "transaction_statement", r"거래명세서|Transaction\s*Statement|공급가액|부가세|총합계"), ("purchase_order", "purchase_order", r"발주서|Purchase\s*Order|납기일|발주수량"),
    ("quotation", "quotation", r"견적서|Quotation|유효기간|예상\s*합계"),
]
AMOUNT_SIGNAL = r"(?i)(?:금액|합계|공급가액|부가세|V\.?A\.?T|total|amount|price)"
CATEGORY_RULES = [
    ("delivery_note", ["납품서", "delivery note"]), ("invoice", ["세금계산서", "invoice"]), ("quotation", ["견적서", "quotation", "quote"]),
    ("purchase_order", ["발주서", "purchase order"]), ("transaction_statement", ["거래명세서", "transaction statement"]),
]
#: Texts that are recognised by how many signals they contain: name -> alternatives of (signals, least number).
CATEGORY_SIGNALS = {
    "implementation_schedule": [
        [(["sheet:", "|", "task", "feature", "status", "claimed"], 3), (["implementation", "schedule", "roadmap", "tracker", "testing", "coverage", "pipeline", "milestone", "owner"], 2)],
        [(["implementation", "schedule", "roadmap", "tracker", "testing", "coverage", "pipeline", "milestone", "owner"], 4)],
    ],
    "installation_guide": [
        [(["installation guide", "setup guide", "technical guide", "project setup", "engineering documentation"], 1)],
        [(["install", "installation", "setup", "configure", "configuration", "environment", "dependencies", "prerequisites", "run", "command", "docker", "api", "database"], 4)],
    ],
    "course_guide": [[(["syllabus", "course code", "semester", "instructor", "office hours", "grading", "required materials"], 2)]],
    "presentation_guide": [[(["presentation", "slide", "audience", "speaker", "rehearse", "talk track", "speaking notes"], 2)]],
}
PROFILE_LINES = [r"(?m)^\s*name\s*:", r"(?m)^\s*(?:student\s+)?id\s*:", r"(?m)^\s*major\s*:", r"(?m)^\s*age\s*:", r"(?m)^\s*department\s*:", r"(?m)^\s*dob\s*:"]
CATEGORY_WORDS = {
    "purchase_order": ["발주서", "발주 번호", "po no", "purchase order", "납기일", "발주일"],
    "quotation": ["견적서", "견적 번호", "quotation", "quote", "유효기간", "견적금액"],
    "transaction_statement": ["거래명세서", "거래 명세서", "transaction statement", "공급가액", "세액"],
    "delivery_note": ["납품서", "납품 번호", "delivery note", "납품일", "인수자"],
    "packing_list": ["포장명세서", "packing list", "포장 수량", "box", "carton"],
    "inspection_report": ["검사성적서", "inspection report", "검사 결과", "합격", "불합격"],
    "purchase_memo": ["발주 메모", "구매 메모", "purchase memo", "단가 확인필요", "자재 입고 요청"],
    "pos_daily_settlement": ["pos 일일정산", "일정산", "daily sales settlement", "실판매금액", "순판매금액"],
    "return_note": ["반품", "차감", "return", "credit note", "rtn"],
    "internal_transfer": ["사업장간", "자재 이동", "내부 이동", "internal transfer", "trf"],
    "contract": ["계약서", "contract", "계약 기간", "계약 금액"],
    "profile_record": ["name:", "id:", "student id", "major:", "age:", "department:", "dob:"],
    "installation_guide": ["installation guide", "setup guide", "install", "installation", "setup", "configuration", "environment variables", "dependencies", "prerequisites"],
    "implementation_schedule": ["implementation", "schedule", "task", "feature", "status", "testing", "coverage", "pipeline", "claimed", "roadmap"],
    "invoice": ["invoice", "invoice number", "vendor", "bill to", "invoice date", "due date", "amount due", "total due"],
    "course_guide": ["syllabus", "course code", "office hours", "grading", "required materials", "instructor"],
    "presentation_guide": ["presentation guide", "speaker notes", "talk track", "slide guidance", "rehearse"],
    "repair_service": ["repair", "service work", "labor", "parts", "maintenance", "technician", "brake"],
    "groceries": ["grocery", "market", "foods", "supermarket", "trader", "whole foods"], "dining": ["restaurant", "cafe", "coffee", "pizza", "burger", "bar", "bakery"],
    "transportation": ["gas", "fuel", "uber", "lyft", "parking", "metro", "taxi"], "utilities": ["electric", "water", "internet", "phone", "utility", "bill"],
    "health": ["pharmacy", "clinic", "doctor", "medical", "dentist"], "office": ["office", "stationery", "printing", "supplies"],
    "notice": ["notice", "announcement", "meeting", "deadline", "reminder"],
}
SPEND_WORDS = {
    "repair_service": ["repair", "service", "labor", "parts", "maintenance", "technician", "brake", "cable", "pedal"],
    "pet_supplies": ["pet", "pets", "dog", "cat", "puppy", "kitten", "litter", "leash", "collar", "kibble", "purina", "friskies"],
    "grocery_style": ["grocery", "produce", "banana", "milk", "bread", "eggs", "deli", "meat", "vegetable", "fruit"],
    "pharmacy_health": ["pharmacy", "rx", "prescription", "medication", "clinic", "vitamin"],
    "home_improvement": ["hardware", "paint", "lumber", "tool", "garden", "plumbing", "electrical"],
    "electronics": ["electronics", "charger", "cable", "battery", "phone", "adapter", "usb"],
    "apparel": ["shirt", "pants", "shoe", "jacket", "apparel", "clothing"],
    "office_supplies": ["office", "paper", "staples", "ink", "toner", "folder", "notebook"],
    "fuel_transport": ["fuel", "gasoline", "diesel", "parking", "toll", "uber", "lyft", "taxi"],
    "meal_or_cafe": ["coffee", "latte", "cafe", "restaurant", "sandwich", "pizza", "burger", "meal"],
}
SPEND_MODES = ["retail", "groceries", "food_drink", "transport", "health", "office", "repair_service"]
NUMBER_FORMS = [
    r"\bFAX(?:[-_][A-Z][A-Z0-9]{1,9})*[-_]PO[-_]\d{4}(?:[-_][A-Z0-9]*\d[A-Z0-9]*)+(?:[-_][A-Z]{1,10}){0,2}\b",
    r"\b(?:FAXx?-)?PO0?[-_ ]?\d{4}[-_]?[0O]?\d{3,4}(?:[-_][A-Z0-9]{2,8}){0,2}\b", r"\bQT[-_ ]?\d{4}[-_]?\d{3,4}(?:[-_][A-Z0-9]{2,8}){0,2}\b",
    r"\bINV[-_ ]?(?:US[-_ ]?)?\d{4}[-_ ]?\d{3,4}(?:[-_][A-Z0-9]{1,8}){0,2}\b", r"\bDN[-_ ]?\d{4}[-_]?\d{3,4}(?:[-_][A-Z0-9]{1,8}){0,2}\b",
    r"\bTS[-_ ]?\d{4}[-_]?\d{3,4}(?:[-_][A-Z0-9]{1,8}){0,2}\b", r"\b(?:I?QC|I[O0]C|QC)[-_ ]?\d{4}[-_]?\d{3,4}(?:[-_][A-Z0-9]{1,8}){0,2}\b",
    r"\b(?:RTN|RCM)[-_ ]?\d{4}[-_]?\d{3,4}(?:[-_][A-Z0-9]{1,8}){0,2}\b", r"\bTRF[-_ ]?\d{4}[-_]?\d{3,4}(?:[-_][A-Z0-9]{1,8}){0,2}\b",
    r"\bMV[-_ ]?\d{4}[-_]?\d{3,4}(?:[-_][A-Z0-9]{1,8}){0,2}\b", r"\bI?DOC[-_ ]?[0O]?\d{2,4}\b",
    r"\b(?:DOC|PM|P[O0]S|RC|PO|QT|INV|DN|TS|IQC|I[O0]C|QC|RTN|RCM|TRF|MV)(?:[-_][A-Z][A-Z0-9]{1,9})*[-_]\d{3,4}(?:[-_][A-Z0-9]*\d[A-Z0-9]*)*(?:[-_][A-Z]{1,10}){0,2}\b",
    r"\bINV(?:[-_ ]+[A-Z]{2,10}){1,3}[-_ ]+\d{3,4}\b",
]
#: Prefixes whose number goes before all others, in this order.
#: Letters in any case without which the form of the same place can't match.
NUMBER_FORM_LETTERS = [
    ["FAX"], ["PO"], ["QT"], ["INV"], ["DN"], ["TS"], ["QC", "IOC", "I0C"], ["RTN", "RCM"], ["TRF"], ["MV"], ["DOC"],
    ["DOC", "PM", "PO", "P0S", "RC", "QT", "INV", "DN", "TS", "IOC", "I0C", "QC", "RTN", "TRF", "MV"], ["INV"],
]
#: The first two letters of every form, before and after the misread prefixes are cleared; the first alone is a cheap test.
NUMBER_BEGINNING = r"(?:[Ff][Aa]|[Pp][Oo0Mm]|[Qq][TtCc]|[Ii][NnQqOo0Dd]|[Dd][NnOo]|[Tt][SsRr]|[Rr][TtCc]|[Mm][Vv])"
NUMBER_FORM_STARTS = ["F", "FP", "Q", "I", "D", "T", "IQ", "R", "T", "M", "ID", "DPRQITM", "I"]  # first letters
PREFERRED_PREFIXES = ["RTN", "RCM", "TRF", "MV"]
#: Misread beginnings of an upper-case number and what they stand for.
NUMBER_REPAIRS = [
    (r"^IDOC(?=-)", "DOC"), (r"^FAXX-", "FAX-"), (r"^P0S(?=-)", "POS"), (r"^I[O0]C(?=-)", "IQC"), (r"^PO0-", "PO-"), (r"^QC-", "IQC-"),
    (r"^S(?=-\d{4}-\d{4}-)", "TS"), (r"^OT(?=-\d{4}-)", "QT"),
]
#: A number that no step of ``normalize_number`` changes.
CLEAN_NUMBER = rf"^(?!{'|'.join(p[1:] for p, _ in NUMBER_REPAIRS)})[A-Z0-9]+(?:-[A-NP-Z0-9]+)*\z"
NUMBER_STARTS = r"^(?:DOC|PM|POS|RC|PO|QT|INV|DN|TS|IQC|IOC|QC|RTN|RCM|TRF|MV|FAX)\b"
NUMBER_TAILS = r"(?i)^(?:\d{2,5}|\d{4}-\d{2,4}(?:-\d{2,5})?|[A-Z]{1,4}-?\d{2,5})$"
REFERENCE_LINE = r"(?i)(원문서|윗문서|완문서|참조문서|관련문서|Original\s*Invoice|Ref(?:erence)?\s*Invoice|승인번호|카드\s*승인번호|Approval\s*No)"
REFERENCE_VALUE = r"(?i)\b(?:DOC|PM|POS|RC|PO|QT|INV|DN|TS|IQC|IOC|QC|RTN|RCM|TRF|MV|FAX)[-_ ]?[A-Z0-9]"
APPROVAL_LINE = r"(?i)(승인번호|카드\s*승인번호|approval\s*(?:no|number))"
RECEIPT_LABEL = r"(?i)(영수증\s*번호|receipt\s*(?:no|number))"
CARD_SLIP_WORDS = r"(?i)(거래일시|품목|공급가액|부가세|카드사)"
NUMBER_PREFIX = "(?i)^(?:DOC|PM|POS|RC|PO|QT|INV|DN|TS|IQC|IOC|QC|RTN|RCM|TRF|MV|FAX-PO)-"
NUMBER_LABELS = [
    "발주번호", "발주 번호", "견적번호", "견적 번호", "거래명세서번호", "납품번호", "계산서번호", "인보이스번호", "청구서번호", "문서번호",
    "영수증번호", "승인번호", "카드승인번호", "전표번호", "정산번호", "메모번호",
    "po no", "po number", "purchase order no", "qt no", "quote no", "quotation no", "statement no", "delivery note no", "dn no", "invoice no", "inv no",
    "receipt no", "receipt number", "approval no", "approval number",
]
ISSUE_LABELS = {
    "purchase_order": ["발행일", "발행일자", "작성일", "발주일", "발주일자", "issue date", "date"], "quotation": ["견적일", "발행일", "작성일", "quotation date", "quote date", "date"],
    "transaction_statement": ["거래일자", "거래일", "발행일", "작성일", "transaction date", "issue date"], "delivery_note": ["발행일", "작성일", "issue date"],
    "invoice": ["작성일자", "작성일", "발행일", "발행일자", "계산서일자", "invoice date", "issue date", "date"],
}
OTHER_ISSUE_LABELS = ["발행일", "작성일", "일자", "issue date"]
DUE_LABELS = {
    "purchase_order": ["납기일", "납기요청일", "납기 요청", "납품요청일", "납품예정일", "납품 예정일", "requested delivery date", "due delivery", "delivery due", "delivery due date", "due date"],
    "quotation": ["유효기간", "견적유효기간", "valid until", "expiration date"], "delivery_note": ["납품일", "납품일자", "delivery date"],
    "invoice": ["지급기한", "결제기한", "payment due date", "payment due", "due date"],
}
DATE_VALUE = r"((?:\d{4}[.\-/년]\s*\d{1,2}[.\-/월]\s*\d{1,2}[일]?)|(?:20\d{2}|19\d{2})\d{2}\d{2})"
BLANK_DATE = r"^(?:연도|년도)\s*[.년]\s*월\s*[.월]\s*일\s*[.일]?$"
PERSON_NAME = r"^[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){0,3}$"
NO_PERSON_WORDS = ["guide", "manual", "schedule", "tracker", "roadmap", "invoice", "statement", "profile", "syllabus"]
COMPUTED_NOTE = r"(?i)(실제\s*품목\s*합계|품목\s*합계는|line\s*item\s*(?:sum|total)|computed)"
AMOUNT_LABEL = r"(?i)(공급\s*[가기궁]액|공급기액|공급액|공급금액|부가세|세액|새액|합계|총합계|결제금액|승인금액|subtotal|supply|vat|tax|total)"
TOTAL_LABEL = r"(?i)(^|\s)(총\s*합계|합계\s*금액|합계|총액|공급대가|청구금액|결제금액|승인금액|grand\s+total|total\s+due|total\s+amount|amount\s+due|total)(\s|[:：]|$)"
OPTION_WORDS = r"(?i)(옵션|option|선택시|옵션별|모두\s*합산)"
LINE_LABELS = {
    "item_name": ["품목명", "품명", "품목", "반품품목", "제품명", "상품명", "자재명", "item name", "item description", "description", "product name", "item"],
    "item_code": ["품목코드", "문서품목코드", "품번", "제품코드", "상품코드", "자재코드", "내부품목코드", "거래처코드", "거래처품목코드", "vendor sku", "customer item code", "sku", "part no", "part number", "item code"],
    "specification": ["규격", "사양", "모델", "모델명", "size", "spec", "specification", "dimension"],
    "quantity": ["수량", "주문수량", "발주수량", "요청수량", "요청수림", "납품수량", "delivery qty", "delivery quantity", "delivered qty", "qty", "quantity"],
    "unit": ["단위", "unit"], "unit_price": ["단가", "단 가", "개당가격", "unit price"],
    "supply_amount": ["공급가액", "공급액", "공급 금액", "supply amount", "subtotal", "amount"], "tax_amount": ["세액", "세 액", "부가세", "vat", "tax", "w세액"],
    "line_total": ["합계금액", "차감합계", "차감 합계", "총액", "금액", "합계", "total", "line total"],
}
COLUMN_ALIASES = {
    "line_number": ["no", "번호"], "item_name": ["품목명", "description", "품명", "품목", "item"], "item_code": ["품목코드", "규격/코드", "내부코드", "hs/code", "lot/code"],
    "spec": ["규격", "spec"], "lot_no": ["lot no", "lot/code"], "quantity": ["수량", "입고수량", "발주수량", "요청수량", "qty"], "unit": ["단위", "unit"],
    "unit_price": ["단가", "unit price"], "supply_amount": ["공급가액"], "tax_amount": ["세액"], "line_total": ["금액", "합계금액", "amount"],
    "inspection_result": ["판정", "검사판정"], "inspection_item": ["검사항목"], "note": ["비고", "이동사유", "이동시유"],
}
FIELD_ALIASES = {
    "document_number": ["문서번호", "document no", "doc no", "invoice no"], "sample_id": ["샘플번호", "sample no", "sample id"],
    "reference_number": ["참조번호", "관련문서번호", "관련 문서번호", "원문서", "원 문서", "reference no", "reference number"],
    "vendor_name": ["공급자", "공급처", "공급업체", "seller", "vendor"], "customer_name": ["공급받는자", "고객사", "buyer", "customer"],
    "issue_date": ["발행일", "작성일", "거래일자", "invoice date", "견적일", "일자", "요청일"], "due_date": ["납기일", "지급기한", "payment due date", "due date"],
    "supply_amount": ["공급가액", "subtotal", "supply amount"], "tax_amount": ["부가세", "세액", "v.a.t", "vat", "tax"],
    "document_total": ["총합계", "총 합계", "합계금액", "결제합계", "청구금액", "결제금액", "합계", "total", "amount due"],
    "estimated_total": ["예상합계", "예상 합계", "견적합계"], "currency": ["통화", "currency"], "exchange_rate": ["exchange rate", "환율"], "total_usd": ["total usd"],
    "krw_converted": ["krw converted", "원화환산"], "from_location": ["출고창고"], "to_location": ["입고창고"], "request_department": ["요청부서"],
}
SECTION_KEYS = ["상호", "사업자번호", "담당", "대표자", "주소"]
SECTION_MARKERS = ["공급자", "공급받는자"]
#: Labels that stand alone on a line, their value below.
LONE_LABELS = [
    "문서번호", "샘플번호", "팸플번호", "생플번호", "생플변호", "생품번호", "생표변호", "생물변호", "참조번호", "관련문서번호", "원문서", "문시빈호", "운서번호", "사업자번호", "사엽자변호",
    "작성일", "작성임", "발행일", "견적일", "유효기간", "납기일", "요청일", "일자", "매장", "담당", "당당", "상호", "입고창고", "출고창고", "요청부서",
    "예상합계", "총합계", "송합계", "총함계", "합계금액", "합계", "함계", "합개", "크레딧합계", "크레뒷합계", "반품합계", "조정합계", "차감합계", "실판매금액", "순판매금액", "과세합계",
    "공급가액", "공급기액", "공급기록", "공급가역", "궁급가액", "부가세", "세액", "세악", "새액", "사물에", "VAT", "V.A.T", "결제합계", "현금합계", "카드합계", "온라인결제", "주문횟수",
    "매장판매", "매장판애", "배달판매", "배달판마", "평균단가",
]
#: Labels that a value may follow without a gap.
GLUED_LABELS = [
    "문서번호", "샘플번호", "생플번호", "생플변호", "참조번호", "관련문서번호", "원문서", "작성일", "발행일", "견적일", "납기일", "요청일", "일자", "상호", "담당", "합계금액", "총합계", "송합계",
    "총함계", "함계", "합개", "크레딧합계", "크레뒷합계", "반품합계", "조정합계", "차감합계",
]
SECTION_LINE = "(?i)공급받는자|공급반는지|궁급받는자|고객사|buyer|customer|공급자|공급처|공급지|seller|vendor"
BROKEN_NUMBER = (r"(?i)^(문서\s*번호|샘플\s*번호|팸플\s*번호)\s*[:：]\s*[A-Za-z]{1,8}$", r"^[-_/]?\s*[A-Za-z0-9]{1,12}$")
HEADER_ROW_TERMS = ["no", "번호", "품목", "품목명", "품명", "description", "규격", "규격코드", "품목코드", "수량", "단위", "단가", "금액", "공급가액", "세액", "합계", "비고"]
SUMMARY_ROW = "(?i)(총합계|합계금액|공급가액합계|세액합계|부가세|vat|subtotal|grandtotal|totalamount)"
SUMMARY_NAMES = ["합계", "총합계", "소계", "공급가액", "세액", "부가세", "vat", "total", "subtotal"]
CANONICAL_HEADERS = {
    "no": ["no", "번호"], "item_name": ["품명", "품목", "품목명", "제품명", "item", "itemname", "description"], "specification": ["규격", "모델", "모델명", "spec", "specification"],
    "lot_code": ["lot", "lotno"], "document_item_code": ["lotcode", "loucode", "code", "품목코드", "문서품목코드"], "item_code": ["itemcode"], "internal_item_code": ["internalitemcode", "내부품목코드"],
    "received_quantity": ["입고수량"], "accepted_quantity": ["합격", "합격수량"], "defective_quantity": ["불량", "불량수량"], "inspection_item": ["검사항목"], "inspection_result": ["검사결과"],
    "result": ["판정", "결과"], "judgment": ["judgment"], "defect_reason": ["defectreason", "불량사유"], "note": ["비고", "remark", "remarks", "note"], "quantity": ["수량", "qty", "quantity"],
    "delivered_quantity": ["납품수량"], "requested_quantity": ["요청수량", "발주수량"], "unit": ["단위", "unit"], "unit_price": ["단가", "unitprice", "unitcost"],
    "supply_amount": ["공급가액", "supplyamount"], "tax_amount": ["세액", "vat", "tax"], "line_total": ["합계", "합계금액", "금액", "amount", "linetotal", "total"],
}
COUNT_FIELDS = ["no", "quantity", "received_quantity", "accepted_quantity", "defective_quantity", "requested_quantity", "delivered_quantity"]
MONEY_FIELDS = ["unit_price", "supply_amount", "tax_amount", "line_total"]
TITLE_WORDS = ["syllabus", "course", "guide", "presentation", "resume", "profile"]
TITLE_PHRASES = ["installation guide", "setup guide", "technical guide", "implementation schedule", "project tracker", "development roadmap"]
IMPORTANT_TERMS = [
    "deadline", "due", "important", "required", "policy", "summary", "instructions", "meeting", "exam", "materials", "skills", "experience", "project", "audience", "speaker", "rehearse",
    "total", "tax", "subtotal", "service", "labor", "parts", "installation", "setup", "configuration", "dependencies", "task", "feature", "status", "testing", "coverage", "pipeline", "claimed", "roadmap",
]
BODY_VERBS = r"\b(is|are|will|introduces|provides|covers|describes|contains|should)\b"
COMPACT_HEADINGS = r"^(chapter|section|lecture|slide|module|unit|problem|homework|assignment|quiz|exam|overview|summary|objectives?|agenda|course|syllabus|sheet|task|feature|status)\b"
COMPACT_WORDS = r"\b(definition|theorem|algorithm|example|steps?|deliverable|due|deadline|required|materials?|instructor|office hours|installation|setup|configuration|dependencies|testing|coverage|pipeline|claimed)\b"
# ------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _contained(text: Column, words) -> Column:
    return F.size(F.filter(_lits(words), lambda w: text.contains(w)))


def _total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _when(cond, value) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), value).otherwise(0)


def _either(words) -> str:
    return "|".join(re.escape(w).replace("\\ ", r"\s*") for w in sorted(words, key=len, reverse=True))


# --- text to lines -------------------------------------------------------------

def explode_lines(df: DataFrame, key: str, col: str = "text") -> DataFrame:
    return df.select(key, F.posexplode(text_lines(col)).alias("pos", "line"))


def html_text(col) -> Column:
    """Comments, script, style and noscript blocks out, tags to line breaks, character references decoded, lines collapsed."""
    t = F.regexp_replace(_c(col), r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "noscript"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return F.array_join(text_lines(unescape(F.regexp_replace(t, "<[^>]+>", "\n"))), "\n")


def flatten_json(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, pos, line): ``a.b[0]: value`` lines of a JSON text in source order, at any depth; none for malformed text."""
    return df.select(key, F.posexplode(json_lines(col)).alias("pos", "line"))


def csv_lines(col) -> Column:
    """Rows as `` | `` joined cells; delimiter, quoted delimiters, line breaks and doubled quotes are understood."""
    return csv_text(_c(col))


def xml_lines(col) -> Column:
    """Elements with text of their own as ``localname: text`` in document order; malformed XML as plain lines."""
    return F.coalesce(xml_text(_c(col)), F.array_join(text_lines(_c(col)), "\n"))


# --- key-values ------------------------------------------------------------------

KNOWN_LABELS = _either({w for ws in FIELD_ALIASES.values() for w in ws} | set(NUMBER_LABELS) | set(SECTION_KEYS))
AMOUNT_LABELS = r"예상\s*합계|합계\s*금액|총\s*합계|송\s*합계|총\s*함계|함계|합개|크레[딧뒷]\s*합계|반품\s*합계|조정\s*합계|차감\s*합계|TOTAL(?:\s+[A-Z]+)?"


BREAKS = r"\n\r\x{85}\x{2028}\x{2029}"  # what ends a line for a pattern


def line_key_values(line: Column, longest_key: int | None = None, longest_value: int | None = None) -> Column:
    """Key-value pairs of one line: known labels with a colon (several per line), any ``label: value``,
    a known label and a space, two-space columns, an amount label and a number, a label glued to its value. Labels of up to 40 characters (30 in
    columns) go first, longer ones are read from lines that no form has taken. Pairs with a key above ``longest_key`` or
    a value above ``longest_value`` characters are left out only if these are given."""
    known = rf"(?i)(?:^|\s)({KNOWN_LABELS})\s*[:：]\s*(.*?)(?=\s+(?:{KNOWN_LABELS})\s*[:：]|$)"
    marked = line.contains(":") | line.contains("：")  # a cheap test before the patterns that need it
    # one word, the only colon and a value of one line are read alike by the first two forms
    plain = marked & line.rlike(rf"^[^\s:：]{{1,40}} *[:：] *[^\s:：{BREAKS}][^:：{BREAKS}]*\z")
    cut_at = lambda c: F.array(F.struct(F.trim(F.substring_index(line, c, 1)).alias("key"), F.trim(F.substring_index(line, c, -1)).alias("value")))
    colon = lambda n: (marked & line.rlike(rf"^\s*[^:：]{n}\s*[:：]"), rf"^\s*([^:：]{n}?)\s*[:：]\s*(.*)$")
    columns = lambda n: (line.rlike(r"\s\s") & found(line, rf"^\s*[가-힣A-Za-z0-9/().\s]{n}\s{{2,}}.+$"), rf"^\s*([가-힣A-Za-z0-9/().\s]{n}?)\s{{2,}}(.+)\s*$")
    named = found(line, rf"(?i)^\s*(?:{KNOWN_LABELS}|{AMOUNT_LABELS}|{_either(GLUED_LABELS)})")
    forms = [
        (marked & found(line, rf"(?i)(?:^|\s)({KNOWN_LABELS})\s*[:：]"), known), colon("{1,40}"),
        (found(line, rf"(?i)^\s*({KNOWN_LABELS})\s+.+$"), rf"(?i)^\s*({KNOWN_LABELS})\s+(.+)\s*$"), columns("{1,30}"),
        (found(line, rf"(?i)^\s*({AMOUNT_LABELS})\s*-?[0-9]"), rf"(?i)^\s*({AMOUNT_LABELS})\s*(-?[0-9][0-9,.]*(?:\s+[0-9][0-9,.]*)?)\s*$"),
        (found(line, rf"^\s*(?:{_either(GLUED_LABELS)})\s*(?![:：]).{{2,}}$"), rf"^\s*({_either(GLUED_LABELS)})\s*(?![:：])(.{{2,}}?)\s*$"),
        colon("{1,}"), columns("{1,}"),
    ]

    def pairs(p: str) -> Column:
        keys, values = (F.regexp_extract_all(line, F.lit(p), F.lit(i)) for i in (1, 2))
        return F.zip_with(keys, values, lambda k, v: F.struct(F.trim(k).alias("key"), F.trim(v).alias("value")))

    first = lambda fs: reduce(lambda acc, f: acc.when(f[0], pairs(f[1])), fs[1:], F.when(fs[0][0], pairs(fs[0][1])))
    # a line that starts with no label and has neither a colon nor a wide gap, such as a row of a table, takes one pattern
    chosen = F.when(plain, F.when(line.contains(":"), cut_at(":")).otherwise(cut_at("："))).otherwise(first(forms[:2]).otherwise(F.when(named | marked | line.rlike(r"\s\s"), first(forms[2:]))))
    fits = lambda v, longest: F.length(v) >= 1 if longest is None else F.length(v).between(1, longest)
    ok = lambda p: fits(p["key"], longest_key) & fits(p["value"], longest_value) & ~p["key"].rlike(r"^[-_./\\|]+$") & ~p["value"].rlike(r"^[-_./\\|]+$") & ~F.lower(p["key"]).isin("document_type", "document_number", "currency", "title", "문서유형", "제목", "통화")
    return F.filter(F.coalesce(chosen, F.array().cast("array<struct<key:string,value:string>>")), ok)


def _paired_lines(lines: Column, longest_key: int | None, longest_value: int | None) -> Column:
    """(line, own, below) per line: the pairs it holds, and the one whose label it is with the value on a line below.

    A document number that breaks off after its letters goes on in the next line. The value below is the next line that is
    more than bars, up to the third, unless a label, a section or a line with pairs of its own comes first."""
    squeezed = lambda v: F.replace(v, F.lit(" "), F.lit(""))  # lines hold no other white space
    lone = lambda v: squeezed(v).isin([w + end for w in LONE_LABELS for end in ("", ":", "：")])
    whole = F.transform(lines, lambda v, i: F.when((v.contains(":") | v.contains("：")) & v.rlike(BROKEN_NUMBER[0]) & F.coalesce(F.get(lines, i + 1).rlike(BROKEN_NUMBER[1]), F.lit(False)), F.concat(v, F.get(lines, i + 1))).otherwise(v))

    def read(v, i):
        raw = F.get(lines, i)
        label = F.trim(F.when(raw.contains(":") | raw.contains("："), F.regexp_replace(raw, r"\s*[:：]\s*$", "")).otherwise(raw))
        section = found(squeezed(raw), SECTION_LINE)
        row = lambda x: F.struct(raw.alias("line"), x["own"].alias("own"), F.when(lone(raw) & ~x["section"], label).alias("label"), x["section"].alias("section"))
        return let(F.struct(line_key_values(v, longest_key, longest_value).alias("own"), section.alias("section")), row)

    def below(rows, i):
        def choose(k):
            r = F.get(rows, i + k)
            value = F.regexp_replace(r["line"], r"^[ |]+|[ |]+$", "")
            later = choose(k + 1) if k < 3 else F.lit(None).cast("string")
            return F.when(r.isNull() | r["section"] | r["label"].isNotNull() | (F.size(r["own"]) > 0), F.lit(None).cast("string")).when(value != "", value).otherwise(later)

        return choose(1)

    def lower(rows):
        def pair(r, i):
            value = F.when(r["label"].isNotNull(), below(rows, i))
            fits = lambda c, longest: F.lit(True) if longest is None else F.length(c) <= longest
            ok = value.isNotNull() & ~value.rlike(r"^[-_./\\|]+$") & fits(r["label"], longest_key) & fits(value, longest_value)
            return F.struct(r["line"].alias("line"), r["own"].alias("own"), F.when(ok, F.struct(r["label"].alias("key"), value.alias("value"))).alias("below"))

        return F.transform(rows, pair)

    # without a label that stands alone no line reads a value below, nor is it asked where sections begin
    alone = lambda w: F.transform(w, lambda v, i: F.struct(F.get(lines, i).alias("line"), line_key_values(v, longest_key, longest_value).alias("own"), none.alias("below")))
    none = F.lit(None).cast("struct<key:string,value:string>")
    return let(whole, lambda w: F.when(F.exists(lines, lone), let(F.transform(w, read), lower)).otherwise(alone(w)))


def key_values(df: DataFrame, key: str, col: str = "text", longest: int | None = None, longest_key: int | None = None, longest_value: int | None = None) -> DataFrame:
    """(id, pos, key, value) rows; ``pos`` orders them inside the document, pairs over two lines after all others. Lines above
    ``longest``, keys above ``longest_key`` and values above ``longest_value`` characters are left out only if these are given."""
    if key in ("key", "value", "pos"):
        raise ValueError(f"the id column can't be named {key}, as an output is")
    rows = df.select(key, F.posexplode_outer(key_value_pairs(col, longest, longest_key, longest_value)).alias("pos", "kv"))  # outer: no filter that reads the text again
    return rows.filter("kv IS NOT NULL").select(key, "pos", "kv.key", "kv.value")


def key_value_pairs(col, longest: int | None = None, longest_key: int | None = None, longest_value: int | None = None) -> Column:
    """The pairs of ``key_values`` as an array in the order of ``pos``, inside the row."""
    lines = text_lines(col) if longest is None else F.filter(text_lines(col), lambda v: F.length(v) <= longest)
    both = lambda rows: F.concat(F.flatten(F.transform(rows, lambda r: r["own"])), F.filter(F.transform(rows, lambda r: r["below"]), lambda p: p.isNotNull()))
    return let(lines, lambda ls: let(_paired_lines(ls, longest_key, longest_value), both))


def carry_sections(df: DataFrame, key: str, col: str = "text", longest_key: int | None = None, longest_value: int | None = None) -> DataFrame:
    """A section marker applies to the following party keys until the next marker. Lengths as in ``key_values``.

    A segmented scan: the places of the markers give the lengths of their stretches, so a text costs time in its lines."""
    marked = f"^({'|'.join(sorted(SECTION_MARKERS, key=len, reverse=True))})(?:\\s|$|[:：])"
    marker = lambda v: F.nullif(F.regexp_extract(v, marked, 1), F.lit(""))

    def sections(lines):
        places = F.filter(F.transform(lines, lambda v, i: F.struct(marker(v).alias("section"), i.alias("at"))), lambda m: m["section"].isNotNull())

        def stretches(ms):
            end = lambda k: F.coalesce(F.get(ms, k + 1)["at"], F.size(lines))
            filled = F.transform(ms, lambda m, k: F.array_repeat(m["section"], end(k) - m["at"]))
            lead = F.array_repeat(F.lit(None).cast("string"), F.coalesce(F.get(ms, F.lit(0))["at"], F.size(lines)))
            return F.concat(lead, F.flatten(filled))

        return let(places, stretches)

    def placed(p, section):
        return F.struct(F.when(p["key"].isin(SECTION_KEYS), section).alias("section"), p["key"].alias("key"), p["value"].alias("value"))

    def pairs(r, section):
        return F.struct(F.transform(r["own"], lambda p: placed(p, section)).alias("own"), F.when(r["below"].isNotNull(), placed(r["below"], section)).alias("below"))

    both = lambda rows: F.concat(F.flatten(F.transform(rows, lambda r: r["own"])), F.filter(F.transform(rows, lambda r: r["below"]), lambda p: p.isNotNull()))
    read = let(text_lines(col), lambda lines: let(F.zip_with(_paired_lines(lines, longest_key, longest_value), sections(lines), pairs), both))
    rows = df.select(key, F.posexplode_outer(read).alias("pos", "p")).filter("p IS NOT NULL")
    return rows.select(key, "pos", "p.section", F.concat_ws(" ", "p.section", "p.key").alias("key"), "p.value")


def replacement_score(key, value) -> Column:
    t, k = F.trim(F.coalesce(_c(value), F.lit(""))), F.regexp_replace(_c(key), r"\s+", "")
    name = k.endswith("상호")
    score = F.least(F.length(t), F.lit(40)) + _when(name, 5) + _when(name & (t.contains("(주)") | t.startswith("주")), 4) - _when(name & t.rlike("(사업자|담당|번호|작성일|품목|합계)"), 10)
    return F.when(t == "", F.lit(-100)).otherwise(score - _when(t.rlike("[A-Za-z가-힣]") & t.rlike(r"\d"), 2))


def dedupe_key_values(kv: DataFrame, key: str) -> DataFrame:
    """One value per (document, normalised key): the highest score, the later one on ties."""
    norm = F.lower(F.trim(F.regexp_replace("key", r"\s+", " ")))
    scored = kv.filter(F.coalesce("value", F.lit("")) != "").withColumn("_s", replacement_score("key", "value"))
    return scored.groupBy(key, norm.alias("norm_key")).agg(F.max_by("value", F.struct("_s", "pos")).alias("value"), F.min("pos").alias("pos"))


def party_score(target: str, key="key", value="value") -> Column:
    texts = F.struct(normalize_label(key).alias("k"), F.trim(F.regexp_replace(F.coalesce(_c(value), F.lit("")), r"\s+", " ")).alias("t"))
    return let(texts, lambda x: _party_points(target, x["k"], x["t"]))


def _party_points(target: str, k: Column, t: Column) -> Column:
    vendor, customer = k.rlike("공급자|공급처|seller|vendor"), k.rlike("공급받는자|고객사|buyer|customer")
    wrong = customer if target == "vendor_name" else (vendor & ~customer)
    mine = vendor if target == "vendor_name" else customer
    score = _when(mine, 40) + _when(k.rlike("상호|업체명|회사명"), 20) + _when(t.contains("(주)") | t.startswith("주"), 10) + _when(t.rlike("[가-힣A-Za-z]"), 5) - _when(t.rlike(r"\d"), 5) - _when(t.rlike("(담당|회계팀|구매팀|품질팀|검사자)"), 25)
    bad = r"(작성일|발행일|거래일자|납기일|승인번호|문서번호|샘플번호|합계|금액|품목|수량|사업자\s*번호)"
    return F.when(t == "", -100).when(t.rlike(r"^\d{3}-?\d{2}-?\d{5}$"), -100).when(found(t, bad), -80).when(F.length(t) > 60, -20).when(wrong, -100).otherwise(score)


def is_party_key(target: str, key="key") -> Column:
    return let(normalize_label(key), lambda k: _names_party(target, k))


PARTY_SIGNAL, PARTY_BLOCKED = "상호|성호|업체명|회사명|거래처|고객사|seller|vendor|buyer|customer", "사업자번호|담당|대표자|주소|전화|번호"


def _names_party(target: str, k: Column) -> Column:
    signal, blocked = found(k, PARTY_SIGNAL), k.rlike(PARTY_BLOCKED)
    if target == "vendor_name":
        return ~blocked & (k.isin("공급자", "공급처", "공급업체", "seller", "vendor") | (k.contains("공급자") & signal) | k.contains("seller") | k.contains("vendor"))
    return ~blocked & (k.isin("공급받는자", "고객사", "buyer", "customer") | (k.contains("공급받는자") & signal) | k.contains("고객사") | k.contains("buyer") | k.contains("customer"))


def pick_field(kv: DataFrame, key: str, target: str) -> DataFrame:
    """Best-scored party value; an equal score goes to the later one; negative scores never win."""
    scored = kv.filter(is_party_key(target) & (F.coalesce("value", F.lit("")) != "")).withColumn("_s", party_score(target)).filter("_s >= 0")
    return scored.groupBy(key).agg(F.max_by("value", F.struct("_s", "pos")).alias(target))


def semantic_fields(kv: DataFrame, key: str, category: DataFrame | None = None) -> DataFrame:
    """Key-values to fields: first alias hit per target, scored parties on top, totals by category, supply + tax inferred."""
    k = normalize_label("key")
    has_value = F.coalesce("value", F.lit("")) != ""

    def first(target: str) -> Column:
        cond = has_value & reduce(lambda a, b: a | b, [k.contains(re.sub(r"[\s:/._·\-]+", "", w.lower())) for w in FIELD_ALIASES[target]])
        if target in ("vendor_name", "customer_name"):
            cond = cond & is_party_key(target)
        return F.min_by("value", F.when(cond, F.col("pos"))).alias(target)

    best = {t: F.max_by("value", F.when(is_party_key(t) & has_value & (party_score(t) >= 0), F.struct(party_score(t), F.col("pos")))).alias(f"_best_{t}") for t in ("vendor_name", "customer_name")}
    agg = kv.groupBy(key).agg(*[first(t) for t in FIELD_ALIASES], *best.values())
    agg = agg.withColumns({t: F.coalesce(f"_best_{t}", t) for t in best}).drop(*[f"_best_{t}" for t in best])
    agg = agg.join(category, key, "left") if category is not None else agg.withColumn("category", F.lit(None).cast("string"))
    return _with_total(agg)


PARTIES = ("vendor_name", "customer_name")


def _known_targets() -> dict[str, list[str]]:
    """The targets of the known labels, so that no text asks for them again."""
    bare = lambda w: re.sub(r"[\s:/._·\-]+", "", w.lower())
    words = {w for ws in FIELD_ALIASES.values() for w in ws} | set(NUMBER_LABELS) | set(SECTION_KEYS) | set(LONE_LABELS) | {"비고"}

    def names(target: str, k: str) -> bool:
        plain, own = (("공급자", "공급처", "공급업체", "seller", "vendor"), "공급자") if target == "vendor_name" else (("공급받는자", "고객사", "buyer", "customer"), "공급받는자")
        inside = ("seller", "vendor") if target == "vendor_name" else ("고객사", "buyer", "customer")
        return not re.search(PARTY_BLOCKED, k) and (k in plain or (own in k and bool(re.search(PARTY_SIGNAL, k))) or any(w in k for w in inside))

    serves = lambda t, k: any(bare(w) in k for w in FIELD_ALIASES[t]) and (t not in PARTIES or names(t, k))
    return {k: [t for t in FIELD_ALIASES if serves(t, k)] + [f"party {t}" for t in PARTIES if names(t, k)] for k in sorted({bare(w) for w in words})}


def _ruled_targets(k: Column) -> Column:
    bare = lambda w: re.sub(r"[\s:/._·\-]+", "", w.lower())
    has = lambda t: reduce(lambda a, b: a | b, [k.contains(bare(w)) for w in FIELD_ALIASES[t]])
    rules = [(t, has(t) & _names_party(t, k) if t in PARTIES else has(t)) for t in FIELD_ALIASES] + [(f"party {t}", _names_party(t, k)) for t in PARTIES]
    return F.array_compact(F.array(*[F.when(cond, F.lit(t)) for t, cond in rules]))


def _targets(k: Column) -> Column:
    """The fields that a normalised label serves, and as ``party …`` the parties that it names: looked up for known labels."""
    known = F.create_map(*[c for w, ts in _known_targets().items() for c in (F.lit(w), F.array(*map(F.lit, ts)) if ts else F.array().cast("array<string>"))])
    return F.coalesce(F.try_element_at(known, k), _ruled_targets(k))


def text_semantic_fields(df: DataFrame, col: str = "text") -> DataFrame:
    """``df`` with the fields of ``semantic_fields`` of each row's own text, read inside the row: its pairs are one array, so
    they are neither exploded nor shuffled back together. Rows without any pair are left out, as they are there. A column
    ``category``, if there is one, chooses the total."""
    pairs = F.filter(key_value_pairs(col), lambda p: F.coalesce(p["value"], F.lit("")) != "")
    served = lambda p: F.struct(let(normalize_label(p["key"]), _targets).alias("targets"), p["key"].alias("key"), p["value"].alias("value"))
    hits = lambda ps: F.flatten(F.transform(ps, lambda p: F.transform(p["targets"], lambda t: F.struct(t.alias("t"), p["value"].alias("value")))))
    placed = lambda ps: let(hits(ps), lambda hs: F.struct(F.size(ps).alias("n"), F.transform(hs, lambda h: h["t"]).alias("t"), F.transform(hs, lambda h: h["value"]).alias("value"), *[best(ps, t).alias(t) for t in PARTIES]))

    def best(ps, target: str) -> Column:
        mine = F.filter(ps, lambda p: F.array_contains(p["targets"], f"party {target}"))
        scored = F.transform(mine, lambda p, i: F.struct(party_score(target, p["key"], p["value"]).alias("s"), i.alias("i"), p["value"].alias("value")))
        return F.array_max(F.filter(scored, lambda r: r["s"] >= 0))["value"]

    rows = df.select("*", F.explode_outer(F.array(let(F.transform(pairs, served), placed))).alias("_p"))  # one row each; so no filter or field reads the text again
    first = lambda target: F.get("_p.value", (F.array_position("_p.t", target) - 1).cast("int"))
    fields = {t: F.coalesce(f"_p.{t}", first(t)) if t in PARTIES else first(t) for t in FIELD_ALIASES}
    rows = rows.filter("_p.n > 0")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in FIELD_ALIASES]
    out = rows.select(*kept, *[v.alias(t) for t, v in fields.items()])
    return _with_total(out if "category" in df.columns else out.withColumn("category", F.lit(None).cast("string")))


def _with_total(agg: DataFrame) -> DataFrame:
    """The document's total by category, else supply and tax."""
    total = (
        F.when(F.col("category") == "quotation", F.coalesce("estimated_total", "document_total"))
        .when(F.col("category") == "commercial_invoice", F.coalesce("total_usd", "document_total", "krw_converted"))
        .otherwise(F.coalesce("document_total", "estimated_total")))
    inferred = N.business_decimal("supply_amount") + N.business_decimal("tax_amount")
    total_number = N.business_decimal("document_total")
    only_supply = F.coalesce((total_number == N.business_decimal("supply_amount")) & (inferred != N.business_decimal("supply_amount")), F.lit(False))
    agg = agg.withColumn("document_total", total)
    return agg.withColumn("document_total", F.when(F.col("document_total").isNull() | only_supply, inferred.cast("decimal(18,2)").cast("string")).otherwise(F.col("document_total")))


def mapping_confidence(n_lines) -> Column:
    have = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 1.0).otherwise(0.0)
    base = (have("document_number") + have("vendor_name") + have("customer_name") + have("issue_date")) / 4
    total = F.when(F.coalesce(F.col("document_total"), F.lit("")) != "", 0.2).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), base + total + F.when(_c(n_lines) > 0, 0.2).otherwise(0.0)), 2)


# --- classification ----------------------------------------------------------------

def classify_profile(col) -> Column:
    """Profile with the most signatures; none when a formal title is present; ties go alphabetically."""
    def score(x):
        has = lambda p: matches(x["t"], x["low"], p)
        scored = F.array(*[F.struct((-_total([_when(has("(?i)" + p), 1) for p in ps])).alias("s"), F.lit(name).alias("p")) for name, ps in PROFILE_SIGNATURES.items()])
        formal = has(FORMAL_TITLE) & ~has(RECEIPT_SIGNAL)
        enough = lambda best: F.when((best["s"] < 0) & ~((best["p"] == "internal_transfer") & (best["s"] > -2)), best["p"])
        return F.when(~formal, let(F.array_min(scored), enough))

    return let(F.trim(collapse(col)), lambda t: let(F.struct(t.alias("t"), F.lower(t).alias("low")), score))


def classify_type(col) -> Column:
    """Type by profile, return wording, handwritten forms, keyword scores, number patterns, then plain words."""
    t = F.coalesce(_c(col), F.lit(""))
    parts = F.struct(
        t.alias("t"), F.lower(t).alias("low"), F.replace(F.lower(collapse(t)), F.lit(" "), F.lit("")).alias("squeezed"), classify_profile(t).alias("profile"),
        F.lower(F.substring_index(t, "\n", 6)).alias("head"))
    return let(parts, _type_rules)


def _type_rules(x: Column) -> Column:
    t, low, squeezed, head, profile = (x[n] for n in ("t", "low", "squeezed", "head", "profile"))
    scores = F.array(*[
        F.struct((_contained(head, [w.lower() for w in words]) * 6 + _contained(low, [w.lower() for w in words]) + _when(matches(t, low, pattern), bonus)).alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("t"))
        for i, (name, words, pattern, bonus) in enumerate(TYPE_WORDS)])
    winner = let(F.array_max(scores), lambda best: F.when(best["s"] >= 7, best["t"]))
    out = F.when(profile == "purchase_memo", "memo").when(profile == "receipt", "receipt").when(profile.isNotNull(), "general_document")
    out = out.when(matches(t, low, r"(?i)\b(?:RTN|RCM)[-_ ]?\d{4}|credit\s+(?:note|memo)|return\s+note"), "general_document")
    for name, pattern in HANDWRITTEN_TYPES:
        out = out.when(matches(squeezed, squeezed, pattern), name)
    rest = F.lit(None).cast("string")
    for name, need, words in reversed(FALLBACK_WORDS):
        rest = F.when(_contained(low, words) >= need, name).otherwise(rest)
    for name, pattern in reversed(NUMBERED_TYPES):
        rest = F.when(matches(low, low, pattern), name).otherwise(rest)
    plain = F.when(F.length(t) > 250, "general_document").otherwise("other")
    return out.otherwise(F.coalesce(winner, rest, plain))


def taxonomy(text, document_type) -> Column:
    """Subtype, profiles, requirements, confidence and evidence by ordered first-match rules."""
    t = F.coalesce(_c(text), F.lit(""))
    return let(F.struct(t.alias("t"), F.lower(t).alias("low")), lambda x: _taxonomy_rules(x["t"], x["low"], _c(document_type)))


def _taxonomy_rules(t: Column, low: Column, kind: Column) -> Column:
    has = lambda p: matches(t, low, p)
    squeezed = F.regexp_replace(low, r"\s+", "")
    warehouses = (squeezed.contains("출고창고") & squeezed.contains("입고창고")) | (has(r"(?i)from\s+warehouse") & has(r"(?i)to\s+warehouse"))
    transfer = has(TRANSFER_WORDS) | (has("내부품목코드|요청수량|요청수림") & warehouses)
    tax_score = _total([
        _when(has(r"(?i)전자\s*세금계산서|세금계산서"), 3), _when(has("사업자등록번호"), 2), _when(has("공급받는자|공급자"), 1), _when(has("공급가액"), 1),
        _when(has("부가세|세액"), 1), _when(has("승인번호|작성일자"), 1), -_when(has(DOLLAR_WORDS), 3)])
    found = lambda name: F.slice(F.array_compact(F.array(*[F.when(has("(?i)" + p), F.lit(p)) for p in EVIDENCE[name]])), 1, 8)

    def out(subtype, profiles, amount, party, confidence, evidence):
        sub = F.lit(subtype).cast("string") if not isinstance(subtype, Column) else subtype
        return F.struct(sub.alias("subtype"), F.lit(profiles[0]).alias("profile"), _lits(profiles).alias("profiles"), F.lit(amount).alias("amount_required"),
                        (party if isinstance(party, Column) else F.lit(party)).alias("party_required"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"))

    plain = F.array(kind)
    return (
        F.when(transfer, out("internal_transfer", ["inventory_movement_document", "no_price_document"], False, False, 0.9, found("internal_transfer")))
        .when(has(RETURN_WORDS), out(F.when(has(CREDIT_WORDS), "credit_note").otherwise("return_note"), ["return_document", "priced_document"], True, True, 0.88, found("return")))
        .when(has(POS_WORDS), out("pos_daily_settlement", ["pos_daily_settlement", "unsupported_line_item_document"], False, False, 0.86, found("pos")))
        .when(has(MEMO_WORDS), out("purchase_memo", ["purchase_memo", "review_required_document"], True, False, 0.82, found("memo")))
        .when((kind == "invoice") & (tax_score >= 4), out("tax_invoice", ["tax_document", "priced_document"], True, True, 0.86, found("tax")))
        .when((kind == "invoice") & has(COMMERCIAL_WORDS), out("commercial_invoice", ["foreign_currency_document", "priced_document"], True, True, 0.82, found("commercial")))
        .when(kind == "delivery_note", out(None, ["no_price_document"], False, True, 0.78, plain))
        .when(kind == "inspection_report", out("incoming_inspection", ["quality_document", "no_price_document"], False, True, 0.78, plain))
        .when(kind.isin("purchase_order", "quotation", "invoice", "transaction_statement"), out(None, ["priced_document"], True, True, 0.65, plain))
        .otherwise(out(None, ["generic_document"], False, ~kind.isin("general_document", "other"), 0.65, plain)))


def preclassify(text, headers) -> Column:
    """Up to five (category, type, score) candidates: .45 keyword, .35 table header, .10 amount words."""
    h = F.array_join(_c(headers), "\x01")  # no pattern spans this character
    texts = F.struct(_c(text).alias("t"), F.lower(text).alias("low"), h.alias("h"), F.lower(h).alias("low_h"))
    return let(let(texts, _scored_types), _best_types)


def _scored_types(x: Column) -> Column:
    """Scores of the types in their order; the table's header cells are searched as one text."""
    amount = F.when(matches(x["t"], x["low"], AMOUNT_SIGNAL), 0.1).otherwise(0.0)
    score = lambda p: F.when(matches(x["t"], x["low"], p), 0.45).otherwise(0.0) + F.when(matches(x["h"], x["low_h"], p), 0.35).otherwise(0.0)
    return let(amount, lambda a: F.array(*[-F.round(F.least(F.lit(1.0), score("(?i)" + p) + a), 2) for _, _, p in SEMANTIC_TYPES]))


def _best_types(scores: Column) -> Column:
    kinds = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(cat).alias("category"), F.lit(kind).alias("document_type")) for i, (cat, kind, _) in enumerate(SEMANTIC_TYPES)])
    rows = F.filter(F.zip_with(scores, kinds, lambda s, k: F.struct(s.alias("neg"), k["o"].alias("o"), k["category"].alias("category"), k["document_type"].alias("document_type"))), lambda r: r["neg"] < 0)
    top = F.slice(F.sort_array(rows), 1, 5)
    return F.transform(top, lambda r: F.struct(r["category"].alias("category"), r["document_type"].alias("document_type"), (-r["neg"]).alias("score")))


def semantic_category(candidates, fallback) -> Column:
    top = F.try_element_at(_c(candidates), F.lit(1))
    return F.when(top["score"] >= 0.45, top["category"]).otherwise(_c(fallback))


def classify_category(col) -> Column:
    """Profile, return and transfer wording, explicit titles, texts with enough signals of a kind, then the family with
    the most contained keywords, the first on ties (one is enough)."""
    t = F.coalesce(_c(col), F.lit(""))
    return let(F.struct(t.alias("t"), F.lower(t).alias("low"), classify_profile(t).alias("profile")), _category_rules)


def _category_rules(x: Column) -> Column:
    t, low, profile = x["t"], x["low"], x["profile"]
    has = lambda p: matches(t, low, p)
    out = F.when(profile.isNotNull(), profile).when(has(RETURN_WORDS), F.when(has(r"(?i)차감|크레딧|credit\s+(?:note|memo)"), "credit_note").otherwise("return_note")).when(has(TRANSFER_WORDS), "internal_transfer")
    for name, words in CATEGORY_RULES:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), name)
    every = lambda parts: reduce(lambda a, b: a & b, [_contained(low, ws) >= n for ws, n in parts])
    signalled = {name: reduce(lambda a, b: a | b, map(every, ways)) for name, ways in CATEGORY_SIGNALS.items()}
    for name, cond in signalled.items():
        out = out.when(cond, name)
    out = out.when(_total([_when(matches(low, low, p), 1) for p in PROFILE_LINES]) >= 2, "profile_record")
    best = F.array_max(F.array(*[F.struct(_contained(low, ws).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("c")) for i, (n, ws) in enumerate(CATEGORY_WORDS.items())]))
    return out.when(best["s"] > 0, best["c"])


def spend_context(col, mode: str = "") -> Column:
    """Keyword family with the most whole-word hits (five count at most); medium confidence from two hits."""
    def best(low):
        return F.array_max(F.array(*[
            F.struct(F.least(F.lit(5), _total([_when(low.rlike(rf"\b{re.escape(w)}\b"), 1) for w in ws])).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("c"))
            for i, (n, ws) in enumerate(SPEND_WORDS.items())]))

    def verdict(b):
        sure = (b["s"] >= 2) | F.lit(mode in SPEND_MODES)
        return F.struct(F.when(b["s"] > 0, b["c"]).alias("subtype"), F.when((b["s"] > 0) & sure, "medium").otherwise("low").alias("confidence"))

    return let(let(F.lower(F.coalesce(_c(col), F.lit(""))), best), verdict)


# --- numbers, amounts, dates ----------------------------------------------------------

def _held(v: Column) -> Column:
    """A text, or null if it is empty; the text is worked out once, where ``nullif`` in a lambda does it twice."""
    return let(v, lambda t: F.when(t != "", t))


def normalize_number(v: Column) -> Column:
    """A document number in upper case with single hyphens, misread beginnings and letters O among digits repaired; null for none.

    Every step is bound, and taken only by texts that hold what it looks for."""
    digits = lambda part, i: (i >= 1) & part.rlike("^[0-9O]{3,4}$") | (i >= 2) & part.rlike("^[0-9O]{2,5}$")
    plain = lambda t: F.array_join(F.transform(F.split(t, "-"), lambda part, i: F.when(digits(part, i), F.replace(part, F.lit("O"), F.lit("0"))).otherwise(part)), "-")
    tight = lambda t: F.when(t.contains("_") | t.contains("--"), F.regexp_replace(t, "[-_]+", "-")).otherwise(t)
    repaired = lambda t: F.when(t.rlike("|".join(p for p, _ in NUMBER_REPAIRS)), reduce(lambda c, repair: F.regexp_replace(c, *repair), NUMBER_REPAIRS, t)).otherwise(t)
    spaced = lambda t: F.when(t.rlike(r"\s"), F.when(t.rlike(NUMBER_STARTS), F.regexp_replace(t, r"[\s_]+", "-")).otherwise(F.regexp_replace(t, r"\s+", ""))).otherwise(t)
    raw = lambda t: F.upper(F.regexp_replace(t, r"^[ \-:：\[\](){}]+|[ \-:：\[\](){}]+$", ""))
    fixed = lambda t: let(let(let(raw(t), spaced), tight), repaired)
    changed = lambda t: _held(let(fixed(t), lambda f: F.when(f.contains("O"), plain(f)).otherwise(f)))
    return let(v, lambda t: F.when(t.rlike(CLEAN_NUMBER), t).otherwise(changed(t)))


def _number_score(v: Column) -> Column:
    return (_when(v.rlike(NUMBER_PREFIX), 40) + _when(v.rlike("^IQC-"), 4) - _when(v.rlike("^IOC-"), 4) + _when(v.rlike(r"^FAX(?:-[A-Z0-9]{2,10})*-PO-"), 40)
            + _when(v.rlike(r"\d{4}"), 10) + _when(F.length(v) - F.length(F.replace(v, F.lit("-"), F.lit(""))) >= 2, 8) - _when(v.rlike("[가-힣]"), 35))


def _without_lines(lines: Column, named: Column, waits) -> Column:
    """Lines without the named ones and, where a named one ``waits`` for its value, without the next line if it is not blank.

    One letter per line: a waiting line takes the next one with it from left to right, which a replacement does as well."""
    def letter(v):
        blank = F.regexp_replace(v, r"[\s\-:：\[\](){}]", "") == ""
        return F.when(named(v), F.when(waits(v), "w").otherwise("n")).when(blank, "b").otherwise("x")

    marks = F.regexp_replace(F.array_join(F.transform(lines, letter), ""), "w[wnx]", "dd")
    return let(F.split(F.regexp_replace(marks, "[wn]", "d"), ""), lambda m: F.filter(lines, lambda v, i: F.get(m, i) != "d"))


def _own_lines(t: Column, receipt: Column | None) -> Column:
    """Text of the lines that can hold the document's own number: no references to other documents; on a receipt no approval
    numbers. Only a text that has such lines is cut."""
    named = lambda v: found(v, REFERENCE_LINE)
    broken = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    less = lambda text, *how: F.array_join(let(F.split(text, "\n"), lambda lines: _without_lines(lines, *how)), "\n")

    def own(text):
        kept = F.when(found(t, REFERENCE_LINE), less(text, named, lambda v: ~v.rlike(REFERENCE_VALUE))).otherwise(text)
        if receipt is None:
            return kept
        approval = lambda v: found(v, APPROVAL_LINE) & ~found(v, RECEIPT_LABEL)
        return F.when(F.coalesce(receipt, F.lit(False)), F.when(found(t, CARD_SLIP_WORDS), text).otherwise(less(text, approval, lambda v: ~v.rlike(r"\d")))).otherwise(kept)

    return let(broken, own)


LONE_NUMBER_LABELS = sorted({re.sub(r"[\s:：#]+", "", w.lower()) for w in NUMBER_LABELS})


def _label_alone(t: Column) -> Column:
    """May some line of a text be only a label of a number? A search of the whole text."""
    between = r"[ \t\x0B\f:：#]*"
    words = "|".join(between.join(map(re.escape, w)) for w in LONE_NUMBER_LABELS)
    return found(t, f"(?im)^{between}(?:{words}){between}$")


def _next_line_numbers(lines: Column) -> Column:
    """(score, -place, number) of numbers below a line that is only a label; up to three more lines may continue one."""

    def whole(i):
        tail = F.transform(F.slice(lines, i + 3, 3), lambda v: F.regexp_replace(F.regexp_replace(v, r"\s+", ""), r"^[ \-:：\[\](){}]+|[ \-:：\[\](){}]+$", ""))
        runs = let(F.filter(tail, lambda v: v != ""), lambda vs: F.filter(vs, lambda v, k: F.forall(F.slice(vs, 1, k + 1), lambda w: w.rlike(NUMBER_TAILS))))
        joined = lambda first: F.when(first.isNotNull(), normalize_number(F.array_join(F.concat(F.array(first), runs), "-")))
        return let(normalize_number(F.get(lines, i + 1)), joined)

    bare = lambda v: F.translate(F.lower(v), " \t\n\x0b\f\r:：#", "")
    at = F.filter(F.transform(lines, lambda v, i: F.when(bare(v).isin(LONE_NUMBER_LABELS) & (i < F.size(lines) - 1), i)), lambda i: i.isNotNull())
    scored = F.transform(at, lambda i: let(whole(i), lambda v: F.struct(_number_score(v).alias("s"), (-i).alias("o"), v.alias("v"))))
    return F.filter(scored, lambda r: r["v"].isNotNull() & (r["s"] >= 20))


def document_number(col, document_type=None) -> Column:
    """The document's own number.

    Return, credit and transfer numbers go first, wherever they stand. Otherwise lines that refer to other documents are left
    out (of a receipt, ``document_type`` 'receipt', those of approvals), then the best-scored number over all prefix forms, the
    longest on ties, competes with those below a line that is only a label; a labelled value is the fallback."""
    receipt = None if document_type is None else _c(document_type) == "receipt"
    return let(F.coalesce(_c(col), F.lit("")), lambda t: _own_number(t, receipt))


def _own_number(t: Column, receipt: Column | None) -> Column:
    form = r"(?i)\b%s[-_ ]?\d{4}[-_ ]?\d{3,4}(?:[-_ ][A-Z0-9]{1,8}){0,2}\b"
    none = F.array().cast("array<string>")
    first = lambda prefix: normalize_number(_held(F.regexp_extract(t, form % prefix, 0)))
    preferred = F.when(found(t, form.replace("(?i)", "(?i)(?=[RTM])") % f"(?:{'|'.join(PREFERRED_PREFIXES)})"), F.coalesce(*map(first, PREFERRED_PREFIXES)))
    clear = lambda v: F.regexp_replace(F.regexp_replace(v, r"(?i)\bP[0O]S(?=[-_ ]?\d{4})", "POS"), r"(?i)\bI[O0]C(?=[-_ ]?\d{4})", "IQC")

    def own(text):
        def strong(held):
            found_in = lambda up: F.array_distinct(F.flatten(F.array(*[
                F.when(reduce(lambda a, b: a | b, [up.contains(w) for w in need]), F.regexp_extract_all(held, F.lit(f"(?i)(?=[{starts}]){p}"), F.lit(0))).otherwise(none)
                for p, need, starts in zip(NUMBER_FORMS, NUMBER_FORM_LETTERS, NUMBER_FORM_STARTS, strict=True)])))
            return F.array_max(F.transform(let(F.upper(held), found_in), lambda v: let(normalize_number(v), lambda c: F.struct(_number_score(c).alias("s"), F.length(c).alias("l"), c.alias("v")))))

        # no form spans lines, so all are read from what follows the first beginning of one in its line
        held = clear(F.array_join(F.regexp_extract_all(text, F.lit(r"(?d)(?=[FfPpQqIiDdTtRrMm])\b" + NUMBER_BEGINNING + ".*"), F.lit(0)), "\n"))
        below = F.when(_label_alone(text), F.array_max(_next_line_numbers(F.transform(F.split(text, "\n"), lambda v: F.trim(v)))))
        labelled = normalize_number(_held(F.regexp_extract(clear(text), rf"(?i)(?:{_either(NUMBER_LABELS)})\s*[:：#]?\s*([A-Za-z0-9가-힣._/-]+)", 1)))
        fallback = let(labelled, lambda c: F.when(_number_score(c) >= 20, c))

        def pick(b):
            strong, below = b["strong"], b["below"]
            wins = below.isNull() | (strong["s"] > below["s"]) | (strong["l"] > F.length(below["v"]) + 3)
            return F.when(strong.isNotNull() & wins, strong["v"]).otherwise(F.coalesce(below["v"], fallback))

        return let(F.struct(let(held, strong).alias("strong"), below.alias("below")), pick)

    return F.coalesce(preferred, let(_own_lines(t, receipt), own))


def _amount_value(token: Column) -> Column:
    """A number token; a trailing c, g or l is a misread last zero."""
    plain = N.digits_decimal(F.regexp_replace(token, "[A-Za-z]$", ""))
    return F.when(token.rlike("[CcGgLl]$"), plain * 10).otherwise(plain)


def labelled_amount(col, labels: list[str]) -> Column:
    """Last value after any label on its line, else on the next line when the label stands alone; computed and note lines are skipped."""
    word = _either(labels)
    value = rf"(?i)(?:^|\s)(?:{word})\s*(?:KRW|USD|₩|원|\$)?\s*[:：]?\s*(?:KRW|USD|₩|원|\$)?\s*([-+]?\d[\d,]*(?:\.\d+)?[A-Za-z]?)\s*(?:원|KRW|USD)?"
    # a label that stands alone, with or without a currency; a label that ends with one loses it and is none
    currencies = ["krw", "usd", "₩", "원", "$"]
    names = [re.sub(r"[\s:：]+", "", w.lower()) for w in labels]
    alone = sorted({n + c for n in names for c in currencies} | {n for n in names if not n.endswith(tuple(currencies))})
    key = lambda v: F.replace(F.replace(F.replace(F.lower(v), F.lit(" "), F.lit("")), F.lit(":"), F.lit("")), F.lit("："), F.lit(""))

    def last(lines):
        def read(v, i):
            direct = F.when(matches(v, F.lower(v), value), F.nullif(F.regexp_extract(v, value, 1), F.lit("")))
            ahead = F.nullif(F.regexp_extract(F.coalesce(F.get(lines, i + 1), F.lit("")), r"[-+]?\d[\d,]*(?:\.\d+)?[A-Za-z]?", 0), F.lit(""))
            token = F.coalesce(direct, F.when(key(v).isin(alone), ahead))
            return let(token, lambda w: F.when(w.isNotNull() & ~v.rlike(COMPUTED_NOTE), _amount_value(w)))

        return F.try_element_at(F.filter(F.transform(lines, read), lambda v: v.isNotNull()), F.lit(-1))

    return let(text_lines(col), last)


def amount_triples(col) -> Column:
    """(supply, tax, total) found in a seven-line window with 10 % tax and a matching sum; the largest total of at least 1000."""
    values_of = lambda v: F.filter(F.transform(F.regexp_extract_all(v, F.lit(r"\d[\d,]*(?:\.\d+)?[A-Za-z]?"), F.lit(0)), _amount_value), lambda x: x > 0)
    tenth, two = F.lit("0.1").cast("decimal(2,1)"), F.lit("0.02").cast("decimal(3,2)")

    def triples(vs):
        n = F.size(vs)
        def at_i(s, i):
            def at_j(j):
                t = F.get(vs, j)
                return F.transform(F.filter(F.sequence(j + 1, j + 3), lambda k: k < n), lambda k: F.struct(F.get(vs, k).alias("total"), s.alias("supply"), t.alias("tax")))
            return F.flatten(F.transform(F.filter(F.sequence(i + 1, i + 4), lambda j: j < n), at_j))
        ok = lambda r: (F.abs(r["tax"] - r["supply"] * tenth) <= F.greatest(F.lit(1).cast(N.LOOSE), r["supply"] * two)) & (F.abs(r["total"] - r["supply"] - r["tax"]) <= F.greatest(F.lit(1).cast(N.LOOSE), r["total"] * two)) & (r["total"] >= 1000)
        return F.filter(F.flatten(F.transform(vs, at_i)), ok)

    def judged(v):
        """Whether a line begins a window and whether it names a total; only a line that may do either is asked for a header."""
        named = F.struct(found(v, AMOUNT_LABEL).alias("start"), (found(v, TOTAL_LABEL) & ~v.rlike(OPTION_WORDS)).alias("total"))
        body = lambda x: F.when(x["start"] | x["total"], ~looks_like_header(v)).otherwise(False)
        return let(named, lambda x: let(body(x), lambda ok: F.struct((x["start"] & ok).alias("start"), (x["total"] & ok).alias("total"))))

    def best(lines):
        # each line is judged and its numbers are read once, not in every window that holds it
        def windows(flags):
            starts = F.filter(F.transform(flags, lambda f, i: F.when(f["start"], i)), lambda i: i.isNotNull())
            return F.filter(starts, lambda i: F.exists(F.slice(flags, i + 1, 7), lambda f: f["total"]))

        def read(starts):
            values = F.transform(lines, lambda v, i: F.when((i >= F.element_at(starts, 1)) & (i < F.element_at(starts, -1) + 7), values_of(v)))
            return F.flatten(let(values, lambda vs: F.transform(starts, lambda i: let(F.flatten(F.slice(vs, i + 1, 7)), triples))))

        return F.array_max(let(let(F.transform(lines, judged), windows), lambda starts: F.when(F.size(starts) > 0, read(starts))))

    return let(text_lines(col), best)


def _labelled_date(text: Column, labels: list[str]) -> Column:
    return extract_date(F.regexp_extract(text, rf"(?i)(?:{_either(labels)})\s*[:：]?\s*{DATE_VALUE}", 1))


def typed_dates(text, document_type) -> Column:
    """Issue and due date by the label list of the document type."""
    t, kind = F.coalesce(_c(text), F.lit("")), _c(document_type)
    by = lambda table: reduce(lambda acc, kv: acc.when(kind == kv[0], _labelled_date(t, kv[1])), list(table.items())[1:], F.when(kind == list(table)[0], _labelled_date(t, table[list(table)[0]])))
    return F.struct(by(ISSUE_LABELS).otherwise(_labelled_date(t, OTHER_ISSUE_LABELS)).alias("issue_date"), by(DUE_LABELS).alias("due_date"))


# --- tables -----------------------------------------------------------------------------

def _lookup(table: dict, strip: str) -> Column:
    pairs = {re.sub(strip, "", w.lower()): field for field, words in table.items() for w in words}
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def line_field(label: Column) -> Column:
    """Line-item field a label names, if any."""
    return F.try_element_at(_lookup(LINE_LABELS, r"[\s_/-]+"), F.regexp_replace(F.lower(F.trim(label)), r"[\s_/-]+", ""))


def names_field(label: Column) -> Column:
    """Does a label name a field? A look into a set, without the field."""
    names = sorted({re.sub(r"[\s_/-]+", "", w.lower()) for words in LINE_LABELS.values() for w in words})
    bare = F.regexp_replace(F.lower(F.trim(label)), r"[\s_/-]+", "")
    return F.when(label.isin(names), F.lit(True)).when(label.rlike("[0-9]"), F.lit(False)).otherwise(bare.isin(names))  # no label has a digit


def split_cells(line: Column) -> Column:
    cut = lambda d: F.transform(F.split(line, d), lambda p: F.trim(p))
    parts = lambda d: F.when(line.contains(d), F.size(F.split(line, d))).otherwise(1)
    return (
        F.when(line.contains("|"), cut(r"\|")).when(line.contains("\t"), cut("\t")).when(parts(",") >= 4, cut(","))
        .when(parts(" / ") >= 3, cut(" / ")).when(line.rlike(r"\s\s"), F.filter(cut(r"\s{2,}"), lambda p: p != "")).otherwise(F.filter(F.array(F.trim(line)), lambda p: p != "")))


def raw_lines(col) -> Column:
    return F.filter(F.transform(cut_lines(F.coalesce(_c(col), F.lit(""))), lambda v: F.trim(v)), lambda v: v != "")


def table_of(col) -> Column:
    """First delimited table: (headers, rows of cells). The header has three or more mapped cells; rows end
    at a line with fewer than three cells or another header."""
    def kind(cells):  # 2 header, 1 row, 0 neither
        mapped = F.size(F.filter(cells, names_field))
        return F.struct(cells.alias("cells"), F.when(F.size(cells) < 3, 0).when(mapped >= 3, 2).otherwise(1).alias("kind"))

    def cut(lines):
        at = F.array_position(F.transform(lines, lambda r: r["kind"]), 2).cast("int")
        rest = lambda i: F.slice(lines, i + 1, F.greatest(F.size(lines) - i, F.lit(0)))

        def upto(body):
            stop = F.array_position(F.transform(body, lambda r: r["kind"] != 1), F.lit(True)).cast("int")
            return let(stop, lambda n: F.when(n > 0, F.slice(body, F.lit(1), n - 1)).otherwise(body))

        made = lambda i: F.when(i > 0, F.struct(F.get(lines, i - 1)["cells"].alias("headers"), F.transform(let(rest(i), upto), lambda r: r["cells"]).alias("rows")))
        return let(at, made)

    return let(F.transform(F.transform(raw_lines(col), split_cells), kind), cut)


def table_items(df: DataFrame, key: str, col: str = "text") -> DataFrame:
    """Rows of the first table with mapped fields; rows without an item name vanish."""
    t = df.select(key, table_of(col).alias("t")).select(key, F.transform("t.headers", line_field).alias("fields"), F.posexplode("t.rows").alias("row", "cells"))
    cell = lambda f: F.get("cells", (F.array_position("fields", f) - 1).cast("int"))
    pick = lambda f: F.when(F.array_contains("fields", f), F.nullif(cell(f), F.lit("")))
    return t.select(key, "row", *[pick(f).alias(f) for f in LINE_LABELS]).filter("item_name IS NOT NULL")


NUM = r"[-+]?\d[\d,]*(?:\.\d+)?"
UNITS = "EA|PCS|SET|KG|BOX|CAN|ROLL|PACK|PK|M|개|식|대|매|박스|세트|봉|장|본|통|캔"


PRICED_ROW = rf"(?i)^(?:\d{{1,3}} )?(.+?)(?: ({NUM}))? ({UNITS}) ({NUM}) ({NUM}) ({NUM}) ({NUM})$"
BARE_ROW = rf"(?i)^(?:\d{{1,3}} )?(.+?) ({NUM}) ({UNITS})(?: .*)?$"


def has_row_items(col) -> Column:
    """Does some line of a text read as an item row without a table around it?"""
    return F.exists(text_lines(col), lambda v: v.rlike(PRICED_ROW) | v.rlike(BARE_ROW))


def row_items(df: DataFrame, col: str = "line") -> DataFrame:
    """One-line rows: trailing price, supply, tax and total after a unit, or quantity and unit at the end."""
    line = F.trim(F.regexp_replace(col, r"\s+", " "))
    priced, bare = PRICED_ROW, BARE_ROW
    is_priced, is_bare = line.rlike(priced), line.rlike(bare)
    g = lambda i, j=None: F.nullif(F.when(is_priced, F.regexp_extract(line, priced, i)).when(is_bare & F.lit(j is not None), F.regexp_extract(line, bare, j or 0)), F.lit(""))
    name = g(1, 1)
    code = F.nullif(F.regexp_extract(name, r"(?:^| )([A-Z]{2,}-[A-Z0-9-]*\d[A-Z0-9-]*)(?: |$)", 1), F.lit(""))
    spec = F.nullif(F.regexp_extract(name, r"(?i)(?:^| )(\d+(?:\.\d+)?(?:x\d+(?:\.\d+)?)+(?:t|mm)?|M\d+(?:x\d+)?|\d+(?:\.\d+)?(?:mm|t))(?: |$)", 1), F.lit(""))
    drop = lambda c, part: F.when(part.isNotNull(), F.trim(F.regexp_replace(F.replace(F.concat(F.lit(" "), c, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")), F.lit(" ")), r"\s+", " "))).otherwise(c)
    number = lambda c: N.digits_decimal(c)
    return df.filter(is_priced | is_bare).select(
        *df.columns, F.nullif(drop(drop(name, code), spec), F.lit("")).alias("r_item_name"), code.alias("r_item_code"), spec.alias("r_specification"),
        number(g(2, 2)).alias("r_quantity"), F.upper(g(3, 3)).alias("r_unit"), number(g(4)).alias("r_unit_price"), number(g(5)).alias("r_supply_amount"),
        number(g(6)).alias("r_tax_amount"), number(g(7)).alias("r_line_total"))


def column_target(header: Column) -> Column:
    """Semantic column by an equal alias, else by a contained one, in the order of the table."""
    key = lambda w: re.sub(r"[\s:/._·\-]+", "", w.lower())

    def pick(n):
        exact = [(t, n.isin([key(w) for w in ws])) for t, ws in COLUMN_ALIASES.items()]
        inside = [(t, reduce(lambda a, b: a | b, [n.contains(key(w)) for w in ws])) for t, ws in COLUMN_ALIASES.items()]
        rules = exact + inside
        return reduce(lambda acc, r: acc.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))

    return let(normalize_label(header), pick)


def semantic_value(col: Column) -> Column:
    """8-digit dates as ISO, bare numbers as their last token without separators, other text as is."""

    def number(token):
        compact = F.regexp_replace(token, r"[^0-9.\-]", "")
        return F.when(~token.contains(",") & compact.rlike(r"^-?\d{1,3}(\.\d{3})+$"), F.replace(compact, F.lit("."), F.lit(""))).otherwise(compact)

    def read(t):
        token = F.try_element_at(F.regexp_extract_all(t, F.lit(r"-?\d[\d,]*(?:\.\d+)*"), F.lit(0)), F.lit(-1))
        plain = t.rlike(r"\d") & ~t.rlike("[A-Za-z가-힣]") & ~t.rlike(r"^\d{4}[./-]\d{1,2}[./-]\d{1,2}$")
        return F.when(t.rlike(r"^20\d{6}$"), F.coalesce(repair_date(t), t)).when(plain, let(token, number)).otherwise(t)

    return let(F.trim(col), read)


def is_semantic_line(raw_text, item_name, item_code, quantity, others: list) -> Column:
    """Keep a mapped row unless it reads like a header or a summary and has a name, a code, or a quantity with some measure."""
    label = lambda c: normalize_label(c)
    terms = _lits([re.sub(r"[\s:/._·\-]+", "", w) for w in HEADER_ROW_TERMS])
    tokens = F.transform(F.filter(F.split(_c(raw_text), r"[\s|,/]+"), lambda p: p != ""), label)
    only_terms = let(tokens, lambda ts: (F.size(ts) > 0) & (F.size(F.array_except(ts, terms)) == 0))
    texts = F.struct(label(raw_text).alias("compact"), label(item_name).alias("name"))
    header = only_terms | let(label(raw_text), lambda c: F.array_contains(terms, c) | c.isin("no품목명규격코드수량단위단가금액", "no품목내부코드수량단위이동사유"))
    summary = let(texts, lambda x: found(x["compact"], SUMMARY_ROW) | x["name"].isin(SUMMARY_NAMES))
    have = lambda c: F.coalesce(_c(c), F.lit("")) != ""
    return ~header & ~summary & (have(item_name) | have(item_code) | (have(quantity) & reduce(lambda a, b: a | b, [have(o) for o in others])))


def _numbered_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows (key, fields, row, cells). The outer form, as Spark puts a filter on the size of an exploded column below the
    projection that makes it, and so computes the table once more for every mention."""
    return df.select(key, "fields", F.posexplode_outer("rows").alias("row", "cells")).filter("row IS NOT NULL")


def _once(value: Column) -> Column:
    """A column that stays where it is made: a filter above it would else be moved below and make it anew for every mention."""
    return F.explode_outer(F.array(value))


def semantic_items(df: DataFrame, key: str, headers: str, rows: str) -> DataFrame:
    """Table rows to semantic lines: columns mapped by alias, values normalised, header and summary rows dropped."""
    t = _numbered_rows(df.select(key, F.transform(headers, column_target).alias("fields"), F.col(rows).alias("rows")), key)
    pairs = F.filter(F.zip_with("fields", "cells", lambda a, b: F.struct(a.alias("f"), b.alias("v"))), lambda z: z["f"].isNotNull() & (F.coalesce(z["v"], F.lit("")) != ""))
    t = t.select(key, "row", F.array_join("cells", " ").alias("_raw"), _once(F.transform(pairs, lambda z: F.struct(z["f"].alias("f"), semantic_value(z["v"]).alias("v")))).alias("_m"))
    pick = lambda f: F.try_element_at(F.filter("_m", lambda z: z["f"] == f), F.lit(-1))["v"]  # the last filled column of a field wins
    picked = t.select(key, "row", "_raw", *[pick(f).alias(f) for f in COLUMN_ALIASES])
    keep = is_semantic_line("_raw", "item_name", "item_code", "quantity", ["unit", "unit_price", "line_total", "supply_amount"])
    return picked.filter(keep).drop("_raw")


def canonical_header(header) -> Column:
    return F.try_element_at(_lookup(CANONICAL_HEADERS, r"[\s_:/()\\-]+"), F.regexp_replace(F.lower(F.coalesce(_c(header), F.lit(""))), r"[\s_:/()\\-]+", ""))


def canonical_rows(df: DataFrame, key: str, headers: str, rows: str, inspection: bool = False) -> DataFrame:
    """Table rows with canonical fields. A bad count keeps its text and raises a flag; inspection tables lose amounts, with a flag."""
    t = _numbered_rows(df.select(key, F.transform(headers, canonical_header).alias("fields"), F.col(rows).alias("rows")), key)
    clean = lambda v: F.nullif(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"\s+", " ")), r"^[ \-:：]+|[ \-:：]+$", ""), F.lit(""))

    pairs = F.filter(F.zip_with("fields", "cells", lambda a, b: F.struct(a.alias("f"), clean(b).alias("v"))), lambda z: z["f"].isNotNull() & z["v"].isNotNull())
    t = t.select(key, "row", _once(pairs).alias("_m"))
    pick = lambda f: F.try_element_at(F.filter("_m", lambda z: z["f"] == f), F.lit(-1))["v"]
    whole = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("bigint").cast("string")
    out = t.select(key, "row", *[pick(f).alias(f) for f in CANONICAL_HEADERS])
    flags = [F.when(F.col(f).isNotNull() & whole(F.col(f)).isNull(), F.lit(f"{f}_parse_review_required")) for f in COUNT_FIELDS]
    if inspection:
        flags += [F.when(reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in MONEY_FIELDS]), F.lit("inspection_report_amount_field_removed")), F.lit("official_table_review_required")]
    typed = {f: F.coalesce(whole(F.col(f)), F.col(f)) for f in COUNT_FIELDS + MONEY_FIELDS}
    if inspection:
        typed.update({f: F.lit(None).cast("string") for f in MONEY_FIELDS})
    out = out.withColumn("review_flags", F.array_sort(F.array_distinct(F.array_compact(F.array(*flags))))).withColumns(typed)
    return out.filter("item_name IS NOT NULL")


def missing_columns(headers, required: list[str]) -> Column:
    return F.array_sort(F.array_except(_lits(required), _c(headers)))


def segment_items(df: DataFrame, key: str, col: str = "text") -> DataFrame:
    """Labelled item blocks: a new item starts at each item-name label once the current one has an identity (a name or a
    code that its last label did not leave empty); unlabelled lines right after the name extend it.

    An identity only depends on the lines since the last item-name label, because such a label is reached without a code or
    starts anew. So the text is cut at the item-name labels, a stretch with an identity ends an item, and every item is read
    from its own lines: time in the lines, no array that grows."""
    fields = list(LINE_LABELS)
    labelled = r"^\s*([^:：|]+?)\s*[:：]\s*(.*?)\s*$"
    ended = r"(?i)(\[item table|공급가액\s*합계|세액\s*합계|총\s*합계|grand total|invoice total|subtotal total|vat total)"

    def read(v):
        label = F.regexp_extract(v, labelled, 1)
        value = F.nullif(F.trim(F.regexp_extract(v, labelled, 2)), F.lit(""))
        return F.struct(F.when(label != "", line_field(label)).alias("field"), value.alias("value"), F.when((label == "") & ~v.rlike(ended), F.trim(v)).alias("more"))

    last = lambda rows, field: F.try_element_at(F.filter(rows, lambda r: r["field"] == field), F.lit(-1))["value"]
    known = lambda rows: last(rows, "item_name").isNotNull() | last(rows, "item_code").isNotNull()
    part = lambda rows, starts, k: F.slice(rows, F.get(starts, k) + 1, F.coalesce(F.get(starts, k + 1), F.size(rows)) - F.get(starts, k))
    zero = F.array(F.lit(0))

    def stretches(rows):  # the places of the item-name labels, the beginning before them
        at = F.filter(F.transform(rows, lambda r, i: F.when(r["field"] == "item_name", i)), lambda i: i.isNotNull())
        return F.concat(zero, at)

    def starts(rows, cuts):  # where items begin
        new = F.transform(cuts, lambda at, k: F.when((k > 0) & known(part(rows, cuts, k - 1)), at))
        return F.concat(zero, F.filter(new, lambda at: at.isNotNull()))

    def name(rows):  # the last item-name label and the unlabelled lines up to the next field
        def extended(tail):
            stop = F.array_min(F.filter(F.transform(tail, lambda r, i: F.when(r["field"].isNotNull() & (i > 0), i)), lambda i: i.isNotNull()))
            more = F.filter(F.transform(F.slice(tail, 1, F.coalesce(stop, F.size(tail))), lambda r: r["more"]), lambda m: m.isNotNull())
            first = F.get(tail, F.lit(0))["value"]
            return F.when(first.isNotNull(), F.array_join(F.concat(F.array(first), more), " "))

        at = F.array_max(F.filter(F.transform(rows, lambda r, i: F.when(r["field"] == "item_name", i)), lambda i: i.isNotNull()))
        return let(at, lambda a: F.when(a.isNotNull(), let(F.slice(rows, F.coalesce(a, F.lit(0)) + 1, F.size(rows)), extended)))

    item = lambda rows: F.struct(*[(name(rows) if f == "item_name" else last(rows, f)).alias(f) for f in fields])
    items = lambda rows, at: F.filter(F.transform(at, lambda _, k: let(part(rows, at, k), item)), lambda i: i["item_name"].isNotNull() | i["item_code"].isNotNull())
    found = let(F.transform(text_lines(col), read), lambda rows: let(let(stretches(rows), lambda cuts: starts(rows, cuts)), lambda at: items(rows, at)))
    return df.select(key, F.posexplode(found).alias("item_no", "i")).select(key, "item_no", "i.*")


# --- ranking lines ---------------------------------------------------------------------

def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def title_score(v: Column, i: Column) -> Column:
    low = F.lower(v)
    sentence = (_words(v) >= 8) & low.rlike(r"\b(is|are|will|introduces|provides|covers|describes|contains)\b")
    score = (
        F.lit(30) - i * 2 + _when(v.rlike(r"\b[A-Z]{2,5}[- ]?\d{3,4}[A-Z]?\b"), 30) + _when(_contained(low, TITLE_WORDS) > 0, 18) + _when(_contained(low, TITLE_PHRASES) > 0, 30)
        - _when(v.contains("|"), 14) + _when(v.rlike("^[A-Z][A-Za-z0-9&,'./() -]{4,}$"), 8) - _when(v.contains(":"), 8)
        - _when(low.rlike(r"^(course description|overview|summary|introduction|objectives?)\s*:"), 28) - _when(low.rlike(r"^(this|these|students|you will|in this course|the purpose of)\b"), 35)
        - _when(_words(v) > 12, 18) - _when(v.endswith("."), 12) - _when(sentence, 22))
    score = score - _when(v.rlike(PERSON_NAME) & (_contained(low, NO_PERSON_WORDS) == 0), 32)
    return F.when(low.rlike(r"^(page|slide)\s+\d+$") | low.rlike(BLANK_DATE), -100).when((F.length(v) < 4) | (F.length(v) > 120), -40).otherwise(score)


def best_title(col) -> Column:
    """Best-scored line of the whole text, the earliest on ties."""
    ranked = F.transform(text_lines(col), lambda v, i: F.struct(title_score(v, i).alias("s"), (-i).alias("o"), v.alias("v")))
    return let(F.array_max(ranked), lambda best: F.struct(best["v"].alias("title"), best["s"].alias("score")))


def unique_lines(col) -> Column:
    both = let(text_lines(col), lambda ls: F.struct(ls.alias("ls"), F.transform(ls, lambda v: F.lower(v)).alias("keys")))
    return let(both, lambda b: F.filter(b["ls"], lambda v, i: F.array_position(b["keys"], F.lower(v)) == i + 1))


def important_lines(col, most_lines: int | None = None) -> Column:
    """The six best of the distinct lines with a score above 6, by score, then by length, then the earlier one. Only the
    first ``most_lines`` distinct lines are scored if it is given."""
    def score(v, i):
        low = F.lower(v)
        body = ((_words(v) >= 10) & low.rlike(BODY_VERBS)) | low.rlike(r"^(course description|overview|summary|introduction|objectives?)\s*:")
        policy = (_contained(low, ["policy", "regulation", "academic integrity", "attendance"]) > 0) & (_contained(low, ["deadline", "exam", "required materials", "grading", "due"]) == 0)
        return (
            _when(v.contains(":") & (F.length(v) <= 100), 16) + _when(_contained(low, IMPORTANT_TERMS) > 0, 18) + _when(v.rlike(r"\b[A-Z]{2,5}[- ]?\d{3,4}[A-Z]?\b"), 18)
            + _when(v.rlike(r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b"), 8) + _when(v.rlike(r"\b\d{1,6}(?:,\d{3})*\.\d{2}\b"), 10) + F.greatest(F.lit(8) - i, F.lit(0))
            - _when(body, 24) - _when(F.length(v) > 140, 20) - _when(policy, 10))

    lines = unique_lines(col) if most_lines is None else F.slice(unique_lines(col), 1, most_lines)
    scored = F.transform(lines, lambda v, i: F.struct((-score(v, i)).alias("neg"), F.length(v).alias("len"), i.alias("i"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda r: (r["neg"] < -6) & (r["len"] >= 4))), 1, 6), lambda r: r["v"])


def compact_text(col, budget: int, terms: list[str] = ()) -> Column:
    """Text within a character budget: fixed anchors and scored lines walk in document order, and a line
    that would overflow is skipped, not cut. The walk is a fold, so it is exact."""
    clean = lambda v: F.regexp_replace(v, r"^[\s\-–—|]+|[\s\-–—|]+$", "")

    def score(v, i, n):
        low = F.lower(v)
        base = (
            _when(i < 40, 18) + _when(i >= F.greatest(F.lit(0), n - 25), 6) + _when((F.length(v) <= 90) & v.rlike(r"^[A-Z0-9][A-Za-z0-9&,:;()/'’ -]{2,}$"), 18) + _when(low.rlike(COMPACT_HEADINGS), 28)
            + _when(v.contains(":") & (F.length(v) <= 180), 20) + _when(v.rlike(r"\b[A-Z]{2,6}[- ]?\d{2,4}[A-Z]?\b"), 18) + _when(v.rlike(r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\b20\d{2}\b"), 10)
            + _when(low.rlike(COMPACT_WORDS), 14) - _when(F.length(v) > 220, 10) - _when(low.rlike(r"^(page|slide)\s+\d+$"), 18))
        return base + (_contained(low, list(terms)) * 16 if terms else 0)

    def step(acc, v):
        add = F.length(v) + 1
        take = (acc["used"] + add <= budget) & ~F.array_contains(acc["keys"], F.lower(v))
        return F.struct(F.when(take, acc["used"] + add).otherwise(acc["used"]).alias("used"), F.when(take, F.array_append(acc["keys"], F.lower(v))).otherwise(acc["keys"]).alias("keys"),
                        F.when(take, F.array_append(acc["out"], v)).otherwise(acc["out"]).alias("out"))

    def pick(b):
        lines, n, mid = b["ls"], b["n"], b["mid"]
        anchor = lambda i: (i < 24) | ((i >= mid - 8) & (i < mid + 8)) | (i >= n - 18)
        usable = lambda v, i: (F.length(v) >= 3) & ~v.rlike(r"^[\W_]+$") & (anchor(i) | (score(v, i, n) > 0))
        init = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out"))
        return F.array_join(F.aggregate(F.filter(lines, usable), init, step, lambda acc: acc["out"]), "\n")

    def within(t):
        made = let(F.transform(text_lines(t), clean), lambda ls: F.struct(ls.alias("ls"), F.size(ls).alias("n"), F.floor(F.size(ls) / 2).alias("mid")))
        return F.when(F.length(t) <= budget, t).otherwise(let(made, pick))

    return let(F.trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"\r\n?", "\n")), within)
