"""Text normalisation, recurrence keys, merchants and categories from descriptions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import vocabulary as V

# The months' names in both languages.
_MONTHS = (
    "gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre|"
    "january|february|march|april|may|june|july|august|september|october|november|december"
)


@cache
def folding() -> tuple[str, str, str, tuple[tuple[str, str], ...]]:
    """From the Unicode tables: marks to delete, letters to replace one by one, their replacements, and longer replacements.

    Only code points matter whose compatibility form has an ASCII letter, digit or space.
    """
    marks, one, to, longer = [], [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        if 0xD800 <= cp <= 0xDFFF:
            continue
        if unicodedata.combining(c):
            if len(unicodedata.normalize("NFKD", c)) >= 1 and all(unicodedata.combining(x) for x in unicodedata.normalize("NFKD", c)):
                marks.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        base = "".join(x if x.isascii() and (x.isalnum() or x == " ") else "\x01" for x in base)
        if any(x != "\x01" for x in base) and base != c:
            if len(base) == 1:
                one.append(c)
                to.append(base)
            else:
                longer.append((c, base))
        elif not base:
            marks.append(c)
    return "".join(marks), "".join(one), "".join(to), tuple(longer)


def normalize_desc(text: Column) -> Column:
    """Lower case without accents; anything but a-z, 0-9 and space is a space; single spaces; trimmed. Null is empty.

    Text in ASCII, which is most of it, skips the Unicode steps.
    """
    marks, one, to, longer = folding()
    text = F.coalesce(text, F.lit(""))
    full = F.translate(F.translate(text, one, to), marks, "")
    # Code points that become several letters are looked up only where there are any.
    table = F.create_map(*[F.lit(x) for pair in longer for x in pair])
    many = "[" + "".join(c for c, _ in longer) + "]"
    spread = F.array_join(F.transform(F.split(full, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    full = F.when(full.rlike(many), spread).otherwise(full)
    folded = F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(full)
    return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))


def recurrence_key(text: Column) -> Column:
    """The normalised text without numbers and month names, runs of single letters joined."""
    bare = F.regexp_replace(normalize_desc(text), "[0-9]+", " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, rf"\b(?:{_MONTHS})\b", " "), r"\s+", " "))
    return F.regexp_replace(bare, r"(?<=(?:^|\s)[a-z])\s(?=[a-z](?:\s|$))", "")


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, n))


def tidy(name: Column) -> Column:
    """Single spaces, no dangling punctuation or trailing long numbers; null if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(name, r"\s+", " "), r"^[ \-,:]+|[ \-,:]+$", "")
    name = F.regexp_replace(F.regexp_replace(name, r"(?:\s+\d{5,})+$", ""), r"^[ \-,:]+|[ \-,:]+$", "")
    return F.nullif(name, F.lit(""))


def clock(hours: Column, minutes: Column) -> Column:
    """HH:mm, or null if it is no time of day."""
    h, m = hours.try_cast("int"), minutes.try_cast("int")
    return F.when((h <= 23) & (m <= 59), F.format_string("%02d:%02d", h, m))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _intesa(d: Column) -> Column:
    # Wordings of the bank's statements, each with a part that all its texts have, and the groups that are wanted.
    none = r"(?i)^\s*(?:Prelievo|Versamento|Bonifico|Stipendio|Trasferimento denaro)"
    wordings = {
        "at": ("alle ore", r"(?i)ALLE ORE\s+(\d{2})[:.]?(\d{2})(?:\d{2})?\b", (1, 2)),
        "ore": ("ore", r"(?i)\bore:?\s*(\d{2})[:.](\d{2})\b", (1, 2)),
        "through": ("tramite pos", r"(?i)Pagamento Tramite POS\s+(.+?)\s*(\d{2})/(\d{2})-(\d{2})[:.](\d{2})", (1, 4, 5)),
        "on": ("su pos", r"(?i)Pagamento su POS\s+(.+?)\s*(\d{2})/(\d{2})(\d{2})(\d{2})\b", (1, 4, 5)),
        "pay": ("bancomat pay", r"(?i)BANCOMAT PAY presso\s+(.+?)\s+data:", (1,)),
        "presso": ("presso", r"(?i)\bPRESSO\s+(.+)$", (1,)),
        "debit": ("addebito diretto", r"(?i)Addebito diretto disposto a favore di\s+(.+?)(?:\s+MANDATO\b|\s+Cod\.?\s|\s*$)", (1,)),
        "adue": ("adue", r"(?i)Pagamento ADUE\b.*?NOME:\s*(.+?)\s*(?:-\s*MANDATO\b|MANDATO\b|$)", (1,)),
    }

    def found(low: Column) -> Column:
        """Each wanted group of each wording, looked for once and only where a text has the wording's mark; '' or null without a match."""
        groups = [F.when(low.contains(mark), F.regexp_extract(d, pattern, n)).alias(f"{name}{n}") for name, (mark, pattern, wanted) in wordings.items() for n in wanted]
        return F.struct(d.rlike(none).alias("none"), *groups)

    def said(g: Column) -> Column:
        has = lambda name: F.coalesce(g[name], F.lit("")) != ""
        named = lambda *names: F.coalesce(*[F.when(has(n), g[n]) for n in names])
        # A time of its own wording comes first; of two such, the first that is there decides, even if it is no time of day.
        time = lambda name, h, m: F.when(has(f"{name}1"), F.coalesce(clock(g[f"{name}{h}"], g[f"{name}{m}"]), F.lit("")))
        own = F.nullif(F.coalesce(time("at", 1, 2), time("ore", 1, 2)), F.lit(""))
        glued = F.when(~g["none"], F.nullif(F.coalesce(time("through", 4, 5), time("on", 4, 5)), F.lit("")))
        who = F.when(~g["none"], named("through1", "on1", "pay1", "presso1", "debit1", "adue1"))
        return F.struct(tidy(who).alias("merchant"), F.coalesce(own, glued).alias("purchase_time"))

    return once(F.lower(d), lambda low: once(found(low), said))


def _revolut(d: Column) -> tuple[Column, Column]:
    # Wordings of the app's own movements.
    system = r"(?i)^\s*(?:Transfer (?:from|to)\b|To\b|From\b|Crypto\b|Exchange[d]?\b|Top[- ]?up\b|Savings\b|Payment from\b|Balance migration\b)"
    return F.when(~(d.rlike(system) | d.rlike(r"(?i)\bTop[- ]?Up by \*")), tidy(d)), F.lit(None).cast("string")


def _trade_republic(d: Column) -> tuple[Column, Column]:
    # Wordings of the broker's statements.
    card = r"(?i)^(.*?)\s*-\s*TR Card Transaction"
    debit = r"(?i)Sepa Direct Debit transfer to\s+(.+?)(?:\s+diretto\s*)?$"
    return F.when(d.rlike(card), tidy(F.regexp_extract(d, card, 1))).when(d.rlike(debit), tidy(F.regexp_extract(d, debit, 1))), F.lit(None).cast("string")


#: Source -> builder of (merchant, purchase time); None says that a source's texts carry none.
STRATEGIES = {"intesa": _intesa, "revolut": _revolut, "trade_republic": _trade_republic}


def extract_merchant(source: Column, description: Column, strategies: dict | None = None) -> Column:
    """struct(merchant, purchase_time) by the source's strategy; both null for other sources and texts.

    A strategy takes the description and returns that struct, or the two as a pair.
    """
    null = F.lit(None).cast("string")
    nothing = F.struct(null.alias("merchant"), null.alias("purchase_time"))
    out = F.when(F.lit(False), nothing)
    for name, strategy in (STRATEGIES if strategies is None else strategies).items():
        if strategy is not None:
            x = strategy(description)
            out = out.when(source == name, F.struct(x[0].alias("merchant"), x[1].alias("purchase_time")) if isinstance(x, tuple) else x)
    return out.otherwise(nothing)


def rule_category(norm: Column, rules=V.RULES) -> Column:
    """The category of the first rule that matches normalised text, else null."""
    out = F.when(norm.rlike("(?i)" + rules[0][0]), rules[0][1])
    for pattern, category in rules[1:]:
        out = out.when(norm.rlike("(?i)" + pattern), category)
    return out


def has_hint(description: Column) -> Column:
    """Whether a description looks like a transfer."""
    return normalize_desc(description).rlike("(?i)" + V.HINT)


def model_text(source: Column, description: Column) -> Column:
    """What a model sees: the merchant if there is one, else the description, normalised."""
    return normalize_desc(F.coalesce(extract_merchant(source, description)["merchant"], description))


def label(code: Column, lang: str = "en") -> Column:
    """The localised label of a category code; '' for null."""
    known = F.create_map(*[F.lit(x) for c, _ in V.LABELS.items() for x in (c, V.label(c, lang))])
    return F.coalesce(F.element_at(known, code), code, F.lit(""))


def person_key(name: Column) -> Column:
    """The set of a name's words, in any order."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(normalize_desc(name), " "))), " ")


def format_holder(name: Column) -> Column:
    """Title case if all in capitals."""
    one = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when(F.upper(one) == one, F.initcap(one)).otherwise(one)


def given_name(name: Column, order: str = "given_first") -> Column:
    """The first or, where the family name comes first, the last word of a name."""
    return F.element_at(F.split(F.trim(name), r"\s+"), 1 if order == "given_first" else -1)
