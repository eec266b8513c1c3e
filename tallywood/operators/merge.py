"""Identity, deduplication and upserts, as joins and folds over immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import natural_key
from ..plans import vocabulary as V


def occurrences(rows: DataFrame) -> DataFrame:
    """Numbers equal (account, day, amount) rows of a file 1, 2 ... in file order."""
    w = W.partitionBy("file", "account", "value_date", F.col("amount").cast("decimal(18,2)")).orderBy("line_no")
    return rows.withColumn("occurrence", F.row_number().over(w))


def keyed(rows: DataFrame) -> DataFrame:
    """With occurrences and natural keys."""
    return occurrences(rows).withColumn("natural_key", natural_key(F.col("account"), F.col("value_date"), F.col("amount"), F.col("occurrence")))


def dedup(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each natural key."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy("natural_key").orderBy(*order))).where("_rn = 1").drop("_rn")


#: Columns of a movement that never change once it is written.
CARRIED = ("amount", "currency", "account", "source", "native_category", "file_id")


def twin_keys(one: DataFrame, other: DataFrame, key: str = "natural_key", part: str | None = None) -> DataFrame:
    """(only_one, only_other, both): how many keys two formats of a statement have alone and in common.

    ``part`` names a column that is the same for all rows of a key, as an account is: tables that are dealt out by it are compared where they are.
    """
    by = [part, key] if part else [key]
    rows = one.select(*by, F.lit(1).alias("side")).union(other.select(*by, F.lit(2).alias("side"))).groupBy(*by).agg(F.bit_or("side").alias("side"))
    return rows.agg(F.count_if(F.col("side") == 1).alias("only_one"), F.count_if(F.col("side") == 2).alias("only_other"), F.count_if(F.col("side") == 3).alias("both"))


def ledger_upsert(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Fold a batch (natural_key, seq, description, merchant, mcc, purchase_time, category, category_source, value_date, booking_date) into the ledger.

    A strictly longer description wins, and with it merchant, mcc, purchase time
    and category; a manual category stays. The booking date is the last that
    differs from the value date. What else both sides have of CARRIED is that of
    the first write, but for the confidence, which goes with the category. All of
    it in closed form over each key's history, so a batch may hold a key any
    number of times, in any order of rows.
    """
    kept = [c for c in CARRIED if c in existing.columns and c in batch.columns]
    sure = [c for c in ("category_confidence",) if c in existing.columns and c in batch.columns]
    cols = [*kept, *sure, "natural_key", "seq", "description", "merchant", "mcc", "purchase_time", "category", "category_source", "value_date", "booking_date"]
    rows = existing.withColumn("seq", F.lit(0).cast("long")).select(*cols).withColumn("old", F.lit(True)).unionByName(batch.select(*cols).withColumn("seq", F.col("seq").cast("long")).withColumn("old", F.lit(False)))
    length = F.length(F.coalesce("description", F.lit("")))
    before = F.max(length).over(W.partitionBy("natural_key").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_grew", before.isNull() | (length > before))
    grew = F.col("_grew")
    last = lambda c: F.max_by(c, F.when(grew & F.col(c).isNotNull(), F.col("seq")))
    g = rows.groupBy("natural_key").agg(
        F.max_by(F.struct("description", "merchant", "category", "category_source", *sure), F.when(grew, F.col("seq"))).alias("best"), last("mcc").alias("mcc"), last("purchase_time").alias("purchase_time"),
        *[F.min_by(c, "seq").alias(c) for c in kept], F.max_by(F.struct("category", "category_source", *sure), F.when(F.col("old") & (F.col("category_source") == "manual"), F.col("seq"))).alias("manual"),
        F.min_by("value_date", "seq").alias("value_date"), F.coalesce(F.max_by("booking_date", F.when(F.col("booking_date") != F.col("value_date"), F.col("seq"))), F.min_by("booking_date", "seq")).alias("booking_date"),
        F.max("old").alias("known"), (F.count_if(grew) - 1).alias("n_enriched"),
    )
    return g.select(
        "natural_key", "value_date", "booking_date", "best.description", "best.merchant", "mcc", "purchase_time",
        F.coalesce(F.col("manual.category"), F.col("best.category")).alias("category"), F.coalesce(F.col("manual.category_source"), F.col("best.category_source")).alias("category_source"),
        *[F.when(F.col("manual").isNotNull(), F.col(f"manual.{c}")).otherwise(F.col(f"best.{c}")).alias(c) for c in sure], *kept, (~F.col("known")).alias("fresh"), (F.col("n_enriched") > 0).alias("enriched"),
    )


def coalesce_upsert(existing: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """New values where there are any, else the old: metadata never gets lost."""
    cols = [c for c in existing.columns if c not in key]
    rows = existing.withColumn("_n", F.lit(0)).unionByName(batch.withColumn("_n", F.lit(1)))
    return rows.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c) for c in cols])


def replace_upsert(existing: DataFrame, batch: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The last write of each key, the batch's rows in order of ``seq``."""
    cols = [c for c in existing.columns if c not in key]
    rows = existing.withColumn(seq, F.lit(-1).cast("long")).unionByName(batch.withColumn(seq, F.col(seq).cast("long")))
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), seq).alias("_x")).select(*key, "_x.*")


def latest(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The value with the largest ``seq`` of each key."""
    return rows.groupBy(key).agg(F.max_by(value, seq).alias(value))


def reapply_feedback(ledger: DataFrame, feedback: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Rows that the latest correction would change, with the corrected category."""
    fix = latest(feedback, "natural_key", "category", "id").withColumnRenamed("category", "corrected")
    fix = fix if keys is None else fix.join(keys, "natural_key", "left_semi")
    return ledger.join(fix, "natural_key").where(~(F.col("category").eqNullSafe(F.col("corrected")) & F.col("category_source").eqNullSafe("manual"))).select("natural_key", F.col("corrected").alias("category"))


def apply_feedback(ledger: DataFrame, feedback: DataFrame) -> DataFrame:
    """The ledger with all corrections in place."""
    fix = latest(feedback, "natural_key", "category", "id").withColumnRenamed("category", "_fix")
    out = ledger.join(fix, "natural_key", "left")
    cols = {"category": F.coalesce("_fix", "category"), "category_source": F.when(F.col("_fix").isNotNull(), "manual").otherwise(F.col("category_source")), "category_confidence": F.when(F.col("_fix").isNotNull(), 1.0).otherwise(F.col("category_confidence")).cast(ledger.schema["category_confidence"].dataType)}
    return out.withColumns(cols).drop("_fix").select(*ledger.columns)


def recategorize(ledger: DataFrame, predicted: DataFrame, only: tuple[str, ...] = ("rule", "default")) -> DataFrame:
    """Categories from predictions (natural_key, new_category, new_source), for rows whose provenance allows it."""
    p = ledger.join(predicted, "natural_key", "left")
    take = F.col("category_source").isin(*only) & F.col("new_category").isNotNull()
    return p.select("natural_key", F.when(take, F.col("new_category")).otherwise(F.col("category")).alias("category"), F.when(take, F.col("new_source")).otherwise(F.col("category_source")).alias("category_source"))


def register_files(known: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """Files to parse: those of unknown content, or not parsed yet; all of them by force."""
    if force:
        return new.dropDuplicates(["sha256"])
    return new.dropDuplicates(["sha256"]).join(known.where("status = 'parsed'").select("sha256"), "sha256", "left_anti")


def failure(candidates: Column, bank: Column) -> Column:
    """Why no adapter reads a file: several fit equally well, its bank has none, or nothing is known of it; null if one fits."""
    several = F.concat(F.lit("Ambiguous statement: it matches "), F.array_join(F.array_sort(candidates), " and "), F.lit(" equally well; name its source."))
    known = F.concat(F.lit("Statement appears to be from "), bank, F.lit(", which has no adapter yet."))
    return F.when(F.size(candidates) > 1, several).when((F.size(candidates) == 0) & bank.isNotNull(), known).when(F.size(candidates) == 0, "Unrecognized statement format.")


def file_status(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """parsed, or failed with the reason, for files (sha256, candidates, and perhaps the bank); the movements' sha256 are counted."""
    n = parsed.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    f = files.join(n, "sha256", "left").withColumn("rows_total", F.coalesce("n", F.lit(0)))
    reason = F.coalesce(failure(F.col("candidates"), F.col("bank") if "bank" in files.columns else F.lit(None).cast("string")), F.when(F.col("rows_total") == 0, "no movements found"))
    return f.select("sha256", "rows_total", F.when(reason.isNull(), "parsed").otherwise("failed").alias("status"), reason.alias("error"))


def record_files(known: DataFrame, outcome: DataFrame) -> DataFrame:
    """The file table with outcomes (sha256, filename, source, status, error) by content; a known file keeps the source it was first given."""
    rows = known.select("sha256", "filename", "source", "status", "error", F.lit(0).alias("_n")).unionByName(outcome.select("sha256", "filename", "source", "status", "error", F.lit(1).alias("_n")))
    return rows.groupBy("sha256").agg(F.min_by("source", "_n").alias("source"), *[F.max_by(c, "_n").alias(c) for c in ("filename", "status", "error")])


def give_up(files: DataFrame, lost: DataFrame) -> DataFrame:
    """Files that wait (pending) and whose job is lost (filename, why) have failed."""
    why = F.concat(F.lit("gave up after retries: "), F.substring("why", 1, 500))
    f = files.join(lost.select("filename", why.alias("_why")).dropDuplicates(["filename"]), "filename", "left")
    hit = (F.col("status") == "pending") & F.col("_why").isNotNull()
    return f.withColumn("error", F.when(hit, F.col("_why")).otherwise(F.col("error"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).drop("_why").select(*files.columns)


def label_upsert(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Machine labels (text_norm, category) into the label table: known (text_norm, source) get the new category, others come with the confidence of a machine."""
    rows = labels.select("text_norm", "source", "category", F.col("confidence").cast("double").alias("confidence"), F.lit(0).alias("_n"))
    mine = new.groupBy("text_norm").agg(F.max("category").alias("category")).select("text_norm", F.lit("llm").alias("source"), "category", F.lit(V.CONFIDENCE["llm"]).alias("confidence"), F.lit(1).alias("_n"))
    return rows.unionByName(mine).groupBy("text_norm", "source").agg(F.max_by("category", "_n").alias("category"), F.min_by("confidence", "_n").alias("confidence"))


def unresolved_shares(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after): the share of the default category."""
    share = lambda d, name: d.agg((F.count_if(F.col("category") == V.DEFAULT) / F.count(F.lit(1))).alias(name))
    return share(before, "before").crossJoin(share(after, "after"))  # one row each


def rename_account(accounts: DataFrame, account_id: str, name: str | None) -> DataFrame:
    """Set or clear an account's display name; KeyError if it isn't there."""
    if accounts.where(F.col("account_id") == account_id).isEmpty():
        raise KeyError(account_id)
    return accounts.withColumn("display_name_override", F.when(F.col("account_id") == account_id, F.lit(name)).otherwise(F.col("display_name_override")))


RESETS = {"data": ("transactions", "trades", "balances", "accounts", "raw_files"), "all": ("transactions", "trades", "balances", "accounts", "raw_files", "training_labels", "feedback")}


def reset(tables: dict[str, DataFrame], scope: str, confirm: str) -> dict[str, DataFrame]:
    """The tables with those of the scope emptied."""
    if scope not in RESETS or confirm != "RESET":
        raise ValueError("scope or confirmation")
    return {k: v.limit(0) if k in RESETS[scope] else v for k, v in tables.items()}
