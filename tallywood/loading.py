"""A ledger as versioned tables, and loads of statement files into it.

A load decodes the files once, finds out whose they are, and folds what they
say into the tables: movements, trades, accounts, declared balances. Each table
changes at once and only in the buckets that are touched; files are marked as
parsed last, so a load that is killed is simply made again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.money import abi
from .functions.text import extract_merchant, format_holder, normalize_desc
from .operators import categorize, detect, merge, transfers
from .operators.versions import Table
from .plans import schema
from .plans import vocabulary as V
from .plans.loader import Vocabulary
from .shared import saved
from .sources import layouts, statement
from .sources.registry import adapters, markers
from .sources.words import addressee

TABLES = {
    "transactions": (schema.TRANSACTIONS, ["natural_key"]), "raw_files": (schema.RAW_FILES, ["sha256"]), "accounts": (schema.ACCOUNTS, ["account_id"]), "balances": (schema.BALANCES, ["account", "balance_date"]),
    "trades": (schema.TRADES, ["natural_key"]), "feedback": (schema.FEEDBACK, ["natural_key"]),
}
_MOVEMENT = "file STRING, line_no BIGINT, account STRING, value_date DATE, booking_date DATE, description STRING, amount DECIMAL(18,4), currency STRING, source STRING, native_category STRING, mcc STRING"


def table(spark: SparkSession, ledger: str, name: str) -> Table:
    """A table of the ledger, empty if it isn't there yet."""
    ddl, keys = TABLES[name]
    t = Table(spark, f"{ledger}/{name}")
    t.create(ddl, keys)
    return t


def names(name: str) -> list[str]:
    return [c.split(" ")[0] for c in TABLES[name][0].split(", ")]


@dataclass(frozen=True)
class Loaded:
    """What a load did."""

    new: int
    enriched: int
    parsed: int
    failed: int


# -------------------------------------------------------------------- scans
def present(files: DataFrame) -> set[tuple[str, str]]:
    """The (source, kind) that there are, so that no others are looked for: adapters times kinds at most."""
    return {(r.source, r.kind) for r in files.where("source IS NOT NULL").select("source", "kind").distinct().collect()}


def _of(rows: DataFrame, files: DataFrame, source: str, kind: str) -> DataFrame:
    """The records of one source and kind."""
    return rows.join(files.where((F.col("source") == source) & (F.col("kind") == kind)).select("file"), "file", "left_semi")


def _union(spark: SparkSession, parts: list[DataFrame], ddl: str) -> DataFrame:
    """The parts with the columns of a schema, null where a part has none."""
    columns = [c.split(" ") for c in ddl.split(", ")]
    out = None
    for part in parts:
        part = part.select(*[(F.col(c) if c in part.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns])
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], ddl) if out is None else out


def movements(rows: DataFrame, files: DataFrame, there: set[tuple[str, str]]) -> DataFrame:
    """The movements of all files (file, source, kind), in the ledger's columns. Lines of pages are numbered through."""
    parts = []
    for source, a in adapters().items():
        of_words = a.options.get("input") == "words"
        if (source, "lines") in there and not of_words:
            parts.append(a.parse(statement.lines(_of(rows, files, source, "lines"))))
        if (source, "words") in there and (of_words or source in layouts.PAGES):
            found = layouts.PAGES.get(source, (a.parse,))[0](statement.words(_of(rows, files, source, "words")))
            parts.append(found.withColumn("line_no", F.col("page").cast("long") * 1_000_000 + F.col("line_no")))
        if (source, "cells") in there and "cells" in a.options:
            parts.append(a.options["cells"](statement.cells(_of(rows, files, source, "cells"))))
    return _union(rows.sparkSession, parts, _MOVEMENT)


def accounts(rows: DataFrame, files: DataFrame, there: set[tuple[str, str]], banks: DataFrame | None) -> DataFrame:
    """One row per account that the files describe; a bank that isn't named is that of the IBAN."""
    parts = []
    for source, a in adapters().items():
        kind = "words" if a.options.get("input") == "words" else "lines"
        if a.accounts is not None and (source, kind) in there:
            parts.append(a.accounts(getattr(statement, kind)(_of(rows, files, source, kind))))
    found = _union(rows.sparkSession, parts, schema.ACCOUNTS)
    columns = [c for c in names("accounts") if c != "account_id"]
    found = found.groupBy("account_id").agg(*[F.max(c).alias(c) for c in columns])
    if banks is not None:
        known = banks.select(F.lpad("abi", 5, "0").alias("_abi"), F.col("bank_name").alias("_bank"))
        found = found.withColumn("_abi", abi(F.col("iban"))).join(known, "_abi", "left").withColumn("bank_name", F.coalesce("bank_name", "_bank"))
    return found.select("account_id", *columns)


def balances(rows: DataFrame, files: DataFrame, there: set[tuple[str, str]]) -> DataFrame:
    """One row per account and day with a declared balance; of several files the last by name counts."""
    parts = []
    for source, a in adapters().items():
        if a.balances is not None and a.options.get("input") != "words" and (source, "lines") in there:
            parts.append(a.balances(statement.lines(_of(rows, files, source, "lines"))))
        if source in layouts.PAGES and (source, "words") in there:
            parts.append(layouts.PAGES[source][1](statement.words(_of(rows, files, source, "words"))))
    found = _union(rows.sparkSession, parts, "file STRING, " + schema.BALANCES)
    return found.groupBy("account", "balance_date").agg(F.max_by(F.struct("balance", "currency", "source", "basis"), F.struct(F.coalesce("file", F.lit("")), "balance")).alias("x")).select("account", "balance_date", "x.*")


def trades(rows: DataFrame, files: DataFrame, there: set[tuple[str, str]], keyed: DataFrame) -> DataFrame:
    """One row per movement that has an instrument side."""
    parts = [a.trades(statement.lines(_of(rows, files, source, "lines"))) for source, a in adapters().items() if a.trades is not None and (source, "lines") in there]
    own = [c for c in names("trades") if c != "natural_key"]
    found = _union(rows.sparkSession, parts, "file STRING, line_no BIGINT, " + schema.TRADES.partition(", ")[2])
    with_key = found.join(keyed.select("file", "line_no", "natural_key"), ["file", "line_no"])
    return with_key.groupBy("natural_key").agg(F.max_by(F.struct(*own), F.struct("file", "line_no")).alias("x")).select("natural_key", "x.*")


def holders(rows: DataFrame, files: DataFrame, there: set[tuple[str, str]]) -> DataFrame:
    """(file, holder) of the files with pages."""
    if not any(kind == "words" for _, kind in there):
        return rows.sparkSession.createDataFrame([], "file string, holder string")
    pages = rows.join(files.where("kind = 'words'").select("file"), "file", "left_semi")
    return addressee(statement.words(pages)).withColumn("holder", format_holder(F.col("holder")))


def categorised(rows: DataFrame, vocabulary: Vocabulary | None) -> DataFrame:
    """Movements with merchant, time of purchase and category."""
    who = extract_merchant(F.col("source"), F.col("description"))
    rows = rows.withColumns({"merchant": who["merchant"], "purchase_time": who["purchase_time"], "norm": normalize_desc(F.col("description"))})
    none = F.lit(None)
    x = categorize.resolve(F.col("mcc"), F.col("merchant"), F.col("norm"), none.cast("string"), none.cast("double"), table=vocabulary.mcc if vocabulary else V.MCC)
    return rows.withColumn("x", x).withColumns({"category": F.col("x.code"), "category_source": F.col("x.source"), "category_confidence": F.col("x.confidence").cast("float")}).drop("x", "norm")


# --------------------------------------------------------------------- load
def identified(files: DataFrame, source: str | None, banks: DataFrame | None) -> DataFrame:
    """Files with candidates, source (if there is one) and bank."""
    known = F.col("head").isNotNull() & F.col("kind").isNotNull()
    found = F.when(known, detect.candidates(F.col("head"), markers()) if source is None else F.array(F.lit(source))).otherwise(F.array().cast("array<string>"))
    files = files.withColumn("candidates", found).withColumn("source", F.when(F.size("candidates") == 1, F.element_at("candidates", 1)))
    return files.withColumn("bank", F.lit(None).cast("string")) if banks is None else detect.identify_bank(files, banks).drop("iban")


def load(spark: SparkSession, ledger: str, rows: DataFrame, source: str | None = None, force: bool = False, vocabulary: Vocabulary | None = None, link: bool = True) -> Loaded:
    """Fold records of statement files (see ``sources.statement``) into a ledger.

    Files of known content are left out unless by force. A file that is too large or
    can't be read, that no adapter or more than one claims, or that has no movements, is
    recorded as failed, with the reason. Movements are numbered by file and line, so
    of two files of one load with the same movement the first by name comes first.
    """
    if source is not None and source not in adapters():
        raise ValueError(f"unknown source {source!r}")
    banks = vocabulary.bank_table(spark) if vocabulary and vocabulary.banks else None
    known, old = table(spark, ledger, "raw_files"), table(spark, ledger, "transactions")
    rows = saved(rows, "records")
    # A file that wasn't read has no content to know it by, so its name and size stand for it.
    found = statement.files(rows).withColumn("sha256", F.coalesce("sha256", F.sha2(F.concat_ws("|", "file", F.col("size").cast("string")), 256)))
    files = saved(identified(merge.register_files(known.read(), found, force), source, banks), "files")
    there = present(files)
    keyed = merge.keyed(movements(rows, files, there)).withColumn("seq", F.row_number().over(W.partitionBy("natural_key").orderBy("file", "line_no")).cast("long"))
    keyed = saved(categorised(keyed, vocabulary).withColumn("file_id", F.xxhash64("file")), "movements")

    counts = {}
    feedback = table(spark, ledger, "feedback").read()

    def fold(have: DataFrame, batch: DataFrame) -> DataFrame:
        out = merge.ledger_upsert(have, batch).join(have.select("natural_key", "transfer_group", "id", "created_at"), "natural_key", "left")
        out = out.withColumns({"id": F.coalesce("id", F.xxhash64("natural_key")), "created_at": F.coalesce("created_at", F.current_timestamp())})
        out = saved(out, "folded")
        counts.update(out.agg(F.count_if("fresh").alias("new"), F.count_if(F.col("enriched") & ~F.col("fresh")).alias("enriched")).first().asDict())
        return merge.apply_feedback(out.select(*names("transactions")), feedback)

    before = old.version()
    old.change(keyed, fold, "load")
    replaced = lambda key: lambda have, batch: merge.replace_upsert(have, batch.withColumn("seq", F.lit(1)), key)
    table(spark, ledger, "trades").change(saved(trades(rows, files, there, keyed), "trades"), replaced(["natural_key"]), "load")
    table(spark, ledger, "accounts").change(saved(accounts(rows, files, there, banks), "accounts"), lambda have, batch: merge.coalesce_upsert(have, batch, ["account_id"]), "load")
    table(spark, ledger, "balances").change(saved(balances(rows, files, there), "balances"), replaced(["account", "balance_date"]), "load")
    if link:
        relink(spark, ledger)
    outcome = saved(_outcome(files, keyed, holders(rows, files, there), old.read(before.number).select("natural_key")), "outcome")
    known.change(outcome, _record, "load")
    status = {r.status: r.n for r in outcome.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Loaded(counts.get("new", 0), counts.get("enriched", 0), status.get("parsed", 0), status.get("failed", 0))


def _outcome(files: DataFrame, keyed: DataFrame, named: DataFrame, old_keys: DataFrame) -> DataFrame:
    """The rows of raw_files that the files get: status with the reason, movements, and those that are new."""
    of = keyed.join(files.select("file", "sha256"), "file")
    status = merge.file_status(files.select("sha256", "candidates", "bank"), of)
    first = of.where("seq = 1").join(old_keys, "natural_key", "left_anti").groupBy("sha256").agg(F.count(F.lit(1)).alias("rows_new"))
    got = files.join(status, "sha256").join(first, "sha256", "left").join(named, "file", "left")
    bad = F.col("problem").isNotNull()
    return got.select(
        F.xxhash64("sha256").alias("id"), "sha256", F.col("file").alias("filename"), F.coalesce("source", "bank", F.lit("unknown")).alias("source"), F.when(bad, "failed").otherwise(F.col("status")).alias("status"),
        F.coalesce("problem", "error").alias("error"), F.col("rows_total").cast("long").alias("rows_total"), F.coalesce("rows_new", F.lit(0)).cast("long").alias("rows_new"), "holder", F.current_timestamp().alias("uploaded_at"),
    )


def _record(have: DataFrame, batch: DataFrame) -> DataFrame:
    """A known file keeps its id, its first source and the time it came; the rest is of the last load."""
    rows = have.withColumn("_n", F.lit(0)).unionByName(batch.withColumn("_n", F.lit(1)))
    kept = ("id", "source", "uploaded_at")
    g = rows.groupBy("sha256").agg(*[(F.min_by if c in kept else F.max_by)(c, "_n").alias(c) for c in have.columns if c != "sha256"])
    return g.select(*have.columns)


def relink(spark: SparkSession, ledger: str, window: int = V.TRANSFER_WINDOW) -> int:
    """Find the transfers of the whole ledger anew; writes the movements whose group changes and returns how many."""
    t = table(spark, ledger, "transactions")
    now = t.read()
    fresh = transfers.relink(now, window).select("natural_key", F.col("transfer_group").alias("_group"))
    changed = saved(now.join(fresh, "natural_key").where(~F.col("transfer_group").eqNullSafe(F.col("_group"))).select("natural_key", "_group"), "links")
    t.change(changed, lambda have, batch: _with(have, batch, "transfer_group", F.col("_group")), "transfers")
    return changed.count()


def _with(have: DataFrame, batch: DataFrame, column: str, value: Column) -> DataFrame:
    hit = batch.withColumn("_hit", F.lit(True))
    return have.join(hit, "natural_key", "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).select(*have.columns)


def correct(spark: SparkSession, ledger: str, corrections: DataFrame) -> None:
    """Record corrections (id, natural_key, category, corrected_by) and apply them: the latest of each movement counts, now and in later loads."""
    rows = saved(corrections.withColumn("created_at", F.current_timestamp()).select(*names("feedback")), "corrections")
    table(spark, ledger, "feedback").change(rows, lambda have, batch: have.unionByName(batch), "feedback")
    table(spark, ledger, "transactions").change(rows, merge.apply_feedback, "feedback")
