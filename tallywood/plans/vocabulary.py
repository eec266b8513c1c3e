"""Categories, rules and parameters. All are data: pass your own to the functions that take them."""

from __future__ import annotations

# Category codes and their labels.
LABELS = {
    "groceries": {"it": "Spesa", "en": "Groceries"},
    "dining": {"it": "Ristorazione", "en": "Dining"},
    "transport": {"it": "Trasporti", "en": "Transport"},
    "travel": {"it": "Viaggi", "en": "Travel"},
    "leisure": {"it": "Tempo libero", "en": "Leisure"},
    "education": {"it": "Istruzione", "en": "Education"},
    "bills": {"it": "Bollette", "en": "Bills & utilities"},
    "subscriptions": {"it": "Abbonamenti", "en": "Subscriptions"},
    "salary": {"it": "Stipendio", "en": "Salary"},
    "rent": {"it": "Affitti", "en": "Rent"},
    "health": {"it": "Salute", "en": "Health"},
    "shopping": {"it": "Acquisti", "en": "Shopping"},
    "transfers": {"it": "Trasferimenti", "en": "Transfers"},
    "investments": {"it": "Investimenti", "en": "Investments"},
    "crypto": {"it": "Crypto", "en": "Crypto"},
    "pension_fund": {"it": "Fondo pensione", "en": "Pension fund"},
    "deposits": {"it": "Conti deposito", "en": "Savings deposits"},
    "insurance": {"it": "Assicurazioni", "en": "Insurance"},
    "insurance_savings": {"it": "Polizze di accumulo", "en": "Savings policies"},
    "cash": {"it": "Contanti", "en": "Cash"},
    "fees": {"it": "Commissioni", "en": "Fees"},
    "other": {"it": "Altro", "en": "Other"},
}
DEFAULT = "other"
ASSETS = ("investments", "crypto", "pension_fund", "deposits", "insurance_savings")

# Rules on normalised text, first match wins.
RULES = (
    (r"\b(?:dividend|cedol(?!in)|coupon|etf|ishares|vanguard|msci|savings plan|piano di accumulo|buy trade|sell trade|tax optimisation|investiment)", "investments"),
    (r"\b(?:crypto|bitcoin|ethereum|coinbase|binance)|\b(?:btc|eth)\b", "crypto"),
    (r"\b(?:interess|interest)", "investments"),
    (r"\b(?:fondo pension|fondi pension|previdenza complementar|pension fund|fondo negoziale|piano individuale pensionistic)", "pension_fund"),
    (r"\b(?:conto deposito|deposito vincolat|deposito svincolat|svincolo|time deposit|term deposit)", "deposits"),
    (r"\b(?:polizza|polizze|assicuraz|insurance|premio assicurativ)|\brc auto\b", "insurance"),
    (r"\b(?:stipend|salary|payroll|emolument|pension)", "salary"),
    (r"\b(?:affitt|locazion)|\brent\b", "rent"),
    (r"\b(?:enel|hera|acea|iren|plenitude|luce|acqua|tari|vodafone|windtre|fastweb|iliad|utilit|bollett)|\b(?:eni|a2a|gas|tim)\b", "bills"),
    (r"\b(?:netflix|spotify|disney|youtube|icloud|google one|dropbox|adobe|abbonament|subscription)|\bprime\b", "subscriptions"),
    (r"\b(?:booking|airbnb|hotel|hostel|ryanair|easyjet|wizzair|vueling|expedia|crocier|aeroport|airport|viagg|flight)|\b(?:volo|voli)\b", "travel"),
    (r"\b(?:trenitalia|italo|atac|uber|freenow|benzin|carburant|terravision|autostrad|telepass|parcheggi|taxi|transport|trasport)", "transport"),
    (r"\b(?:cinema|multisala|teatr|concert|ticketone|eventim|museo|musei|stadio|palestr|piscina|bowling)", "leisure"),
    (r"\b(?:ristorant|pizzeri|pizza|osteria|trattoria|caffe|mcdonald|burger|kebab|sushi|glovo|deliveroo|just ?eat|restaurant|dining)|\bbar\b", "dining"),
    (r"\b(?:esselunga|coop|conad|carrefour|lidl|eurospin|penny|supermercat|grocer|market|aliment)|\bpam\b", "groceries"),
    (r"\b(?:farmac|pharmac|dottor|medic|ottic|health|salute|cura della persona)", "health"),
    (r"\b(?:ikea|decathlon|zara|amazon|feltrinelli|salmoiraghi|shopping|acquist)", "shopping"),
    (r"\b(?:preliev|withdrawal|contant)|\b(?:atm|cash)\b", "cash"),
    (r"\b(?:commission)|\b(?:fee|fees)\b", "fees"),
    (r"\b(?:bonific|transfer|giroconto|topup|top up|ricarica|sepa|incoming|outgoing)", "transfers"),
)
# Words by which a text says that it is a transfer.
HINT = r"\b(bonific|giroconto|giro\b|sepa|transfer|top ?up|topup|ricarica|incoming|outgoing)"

# Rhythm windows in days, and the other limits of the analyses.
CADENCES = (("weekly", 5, 10), ("monthly", 24, 38), ("bimonthly", 50, 75), ("quarterly", 78, 110), ("semiannual", 155, 220), ("yearly", 330, 430))
RECURRENCE = {"min_days": 3, "regularity": 0.7, "pair_ratio": "1.5", "consistency": 0.7, "strict_regularity": 0.9, "grace_factor": 0.35, "grace_days": 21, "month_days": "30.44", "merge_ratio": "1.25"}
COVERAGE = {"hole_factor": 1.8, "hole_days": 45, "stale_factor": 1.5, "stale_days": 45}
TRANSFER_WINDOW = 4
MODEL_THRESHOLD = 0.75
CONFIDENCE = {"mcc": 1.0, "rule": 0.9, "manual": 1.0, "llm": 0.75, "default": 0.0}
NEIGHBOURS = 5

# Fixed values.
#: Marker groups by source: a head text is of a source if all markers of one of its groups are in it.
MARKERS = {
    "intesa": (("intesa sanpaolo",), ("conti e carte",)),
    "revolut": (("current accounts summaries",), ("revolut",), ("money in/out", "balance")),
    "trade_republic": (("asset_class", "transaction_id"), ("trade republic",)),
}

#: A small merchant-code table to start from; load the full one as {code or "lo-hi": category}.
MCC = {"5411": "groceries", "5812": "dining", "5814": "dining", "4111": "transport", "4121": "transport", "7011": "travel", "5912": "health", "4900": "bills", "6011": "cash", "3000-3350": "travel", "3351-3500": "travel", "3501-3999": "travel"}


def label(code: str | None, lang: str = "en") -> str:
    """The label in a language, else in English, else the code; a null code is empty."""
    if code is None:
        return ""
    known = LABELS.get(code, {})
    return known.get(lang) or known.get("en") or code


def setting(tree: dict, path: str, default=None):
    """A value by dotted path."""
    for part in path.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return default
        tree = tree[part]
    return tree
