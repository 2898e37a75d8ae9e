"""Names and limits of the two forms. Records and ledgers carry these names."""

EVAL_ITEMS = ("a1", "a2", "b1", "b2", "c1", "c2", "c3", "d1", "d2", "d3")
BONUS_ITEMS = ("e1", "e2")
SCORE, LIMIT, BONUS, NOTE, MEETS = "得分", "評分", "加分", "說明", "是否符合"
TOTAL, GRADE = "評核總分", "評核等級"
SUPPLIER, CATEGORY, PURCHASE, UNIT, PERSON, DATE = "供應商名稱", "評核類別", "採購項目", "評核單位", "評核人員", "評核日期"
SOURCE_FILE, PROCESSED = "_來源檔案", "_處理時間"
ROLLUP_PREFIX = "彙總("
TAX_ID, COMPANY = "統一編號/身份證號", "公司全名(中文)"
UNNAMED = "未命名供應商"
ATTACHMENT_PREFIX = "附件"
BONUS_CAP = 10

# Payload keys, document types and their other names, limits.
HEADER_FIELDS = (SUPPLIER, CATEGORY, PURCHASE, UNIT, PERSON, DATE)
SUPPLIER_KEYS = {
    "公司全名(中文)": "company_name_zh",
    "公司全名(英文)": "company_name_en",
    "統一編號/身份證號": "tax_id",
    "服務範疇": "service_scope",
    "核准設立日期(年/月/日)": "established_date",
    "資本額(單位:萬元)": "capital",
    "聯絡地址": "contact_address",
    "帳單地址": "billing_address",
    "負責人": "responsible_person",
    "公司電話": "company_phone",
    "聯絡人": "contact_person",
    "連絡電話": "contact_phone",
    "匯款帳戶戶名": "bank_account_name",
    "匯款銀行": "bank_name",
    "分行別": "branch_name",
    "匯款帳號": "bank_account",
    "發票類型": "invoice_type",
    "課稅別": "tax_type",
    "填表人": "preparer",
    "填表日期": "form_date",
}
DOC_TYPES = {"supplier_form": 1, "supplier_evaluation": 2}  # with the pages each needs
DOC_ALIASES = {
    "vendor_form": "supplier_form",
    "supplier": "supplier_form",
    "evaluation": "supplier_evaluation",
    "eval_form": "supplier_evaluation",
    "supplier_eval": "supplier_evaluation",
}
MAX_BYTES = 20 * 1024 * 1024
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")


def score_fields() -> list[str]:
    """The number fields of an evaluation, in form order."""
    return [f"{i}_{SCORE}" for i in EVAL_ITEMS] + [f"{i}_{BONUS}" for i in BONUS_ITEMS]
