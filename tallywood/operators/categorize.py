"""Categories: merchant codes, rules, a nearest-neighbour model, and what to do with their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rule_category
from ..plans import vocabulary as V


def mcc_category(mcc: Column, table: dict[str, str] | None = None) -> Column:
    """The category of an exact code, else of the range it is in; the table is a few hundred literals."""
    table = V.MCC if table is None else table
    exact = {k: v for k, v in table.items() if "-" not in k}
    n = F.when(mcc.rlike(r"^\d{4}$"), mcc.cast("int"))
    out = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(exact.items()) for x in kv]), mcc) if exact else F.lit(None).cast("string")
    for k, v in table.items():
        if "-" in k:
            low, high = map(int, k.split("-"))
            out = F.coalesce(out, F.when(n.between(low, high), v))
    return F.when(mcc.isNotNull(), out)


def resolve(mcc: Column, merchant: Column, norm: Column, predicted: Column, confidence: Column, threshold: float = V.MODEL_THRESHOLD, table: dict | None = None) -> Column:
    """struct(code, confidence, source). Codes first; then, with a merchant, the model before the rules, else the rules before the model; then the default."""
    code, rule = mcc_category(mcc, table), rule_category(norm)
    sure = predicted.isNotNull() & (confidence.cast("double") >= threshold)
    made = lambda c, p, s: F.struct(c.alias("code"), (p if isinstance(p, Column) else F.lit(p)).cast("double").alias("confidence"), F.lit(s).alias("source"))
    c = V.CONFIDENCE
    return (
        F.when(code.isNotNull(), made(code, c["mcc"], "mcc"))
        .when(merchant.isNotNull() & sure, made(predicted, confidence, "model"))
        .when(rule.isNotNull(), made(rule, c["rule"], "rule"))
        .when(sure, made(predicted, confidence, "model"))
        .otherwise(made(F.lit(V.DEFAULT), c["default"], "default"))
    )


def needs_model(rows: DataFrame, table: dict | None = None) -> DataFrame:
    """Rows that no code decides and, without a merchant, no rule: only they go to a model."""
    return rows.where(mcc_category(F.col("mcc"), table).isNull() & (F.col("merchant").isNotNull() | rule_category(F.col("norm")).isNull()))


def with_model(rows: DataFrame, model, text: str = "text") -> DataFrame:
    """Adds predicted and confidence from a model object: one with predict_batch(texts), predict_one(text), or predict_proba(texts) and classes_.

    The first two answer (code, confidence) or None. The model goes to the tasks
    with their closure and sees texts in Arrow batches; a text that it fails on has no answer.
    """

    def one(x: str):
        try:
            if hasattr(model, "predict_one"):
                return model.predict_one(x)
            share = list(model.predict_proba([x])[0])
            best = max(range(len(share)), key=share.__getitem__)
            return str(model.classes_[best]), float(share[best])
        except Exception:  # a model that fails leaves the text to the rules
            return None

    def run(frames):
        for f in frames:
            texts = f[text].fillna("").tolist()
            got = list(model.predict_batch(texts)) if hasattr(model, "predict_batch") else [one(x) for x in texts]
            yield f.assign(predicted=[g[0] if g else None for g in got], confidence=[float(g[1]) if g else None for g in got])

    names = [c for c in rows.columns if c not in ("predicted", "confidence")]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*names).dtypes)
    return rows.select(*names).mapInPandas(run, f"{schema}, predicted string, confidence double")


def labelled_by(texts: DataFrame, ask, labels=V.LABELS, default: str = V.DEFAULT) -> DataFrame:
    """(text_norm, category) from a callable that gets a text and answers JSON, {"category": code}; answers that are no known code are left out.

    ``ask`` runs in the tasks and holds whatever speaks to a language model; see :func:`prompt`.
    """

    def run(frames):
        for f in frames:
            yield f.assign(answer=[ask(x) for x in f["text_norm"]])[["text_norm", "answer"]]

    rows = texts.select("text_norm").where("text_norm <> ''").distinct().mapInPandas(run, "text_norm string, answer string")
    code = F.get_json_object("answer", "$.category")
    return rows.select("text_norm", code.alias("category")).where(F.col("category").isin(*labels, default))


def prompt(labels=V.LABELS, examples: tuple[tuple[str, str], ...] = ()) -> str:
    """What a language model is told before a description: the codes, the rules of the house and examples."""
    codes = "\n".join(f"{code}: {', '.join(names.values())}" for code, names in labels.items())
    shown = "\n".join(f"{text} = {code}" for text, code in examples)
    return f"Choose one category for a bank movement. Codes:\n{codes}\nCard payments go by their merchant; '{V.DEFAULT}' if it can't be told.\n{shown}\nAnswer as JSON: {{\"category\": code}}"


# ------------------------------------------------------------------- neighbours
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector scaled to length 1."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)


def _stacked(column: list):
    import numpy as np

    return np.stack(column)


def knn(queries: DataFrame, labelled: DataFrame, k: int = V.NEIGHBOURS, block: int = 8192, others: bool = False, dense=None) -> DataFrame:
    """(query_id, rank, vec_id, label, sim): the k nearest labelled vectors by dot product, ties by id; with ``others`` a query's own row doesn't count.

    Queries (query_id, vector) and the labelled set (vec_id, vector, label) are
    dealt into blocks of some ``block`` vectors. Each block of queries meets each
    labelled block as two matrices in one task, which keeps k candidates for a
    query; these are merged by rank. Only two counts reach the driver. With ``dense``
    the column ``vector`` is something smaller, which that makes a matrix of.

    Products in float32 tell which vectors can be among the k nearest, by a bound of
    their error; those are multiplied again in float64.
    """
    kind = dict(labelled.dtypes)["label"]
    many = lambda d: max(1, -(-d.count() // block))
    rows, columns = many(queries), many(labelled)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vector = (F.col("vector").cast("array<double>") if dense is None else F.col("vector")).alias("vector")
    matrix_of = dense or _stacked
    q = queries.select("query_id", vector, part("query_id", rows).alias("i"), each(columns).alias("j"))
    v = labelled.select("vec_id", vector, "label", each(rows).alias("i"), part("vec_id", columns).alias("j"))

    def near(a, b):
        import numpy as np
        import pandas as pd

        got: list[tuple] = []
        if len(a) and len(b):
            b = b.sort_values("vec_id")
            ids, labels, matrix = b["vec_id"].to_numpy(), b["label"].to_numpy(), matrix_of(b["vector"].to_list())
            short, longest = np.ascontiguousarray(matrix.astype(np.float32).T), np.sqrt((matrix * matrix).sum(1)).max()
            least = max(len(b) - k - others, 0)
            for s in range(0, len(a), 256):
                some = a.iloc[s : s + 256]
                mine = matrix_of(some["vector"].to_list())
                about = mine.astype(np.float32) @ short
                slack = 4 * (matrix.shape[1] + 4) * 2.0**-24 * longest * np.sqrt((mine * mine).sum(1)) + 1e-11
                row, n = np.nonzero(about >= (np.partition(about, least, axis=1)[:, least] - slack)[:, None])
                sims = (mine @ matrix.T)[row, n] if len(row) > 64 * len(some) else np.einsum("ij,ij->i", mine[row], matrix[n])
                asked = some["query_id"].to_numpy()
                if others:
                    kept = asked[row] != ids[n]
                    row, n, sims = row[kept], n[kept], sims[kept]
                order = np.lexsort((n, -np.round(sims, 12), row))
                row, n, sims = row[order], n[order], sims[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                got += zip(asked[row[first]].tolist(), ids[n[first]].tolist(), labels[n[first]].tolist(), sims[first].tolist(), strict=True)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "label", "sim"])

    found = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInPandas(near, f"query_id long, vec_id long, label {kind}, sim double")
    w = W.partitionBy("query_id").orderBy(F.round("sim", 12).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame) -> DataFrame:
    """(query_id, label, score, confidence): the label with the largest sum of similarities (ties: the one met first), and its best similarity."""
    g = neighbours.groupBy("query_id", "label").agg(F.sum("sim").alias("score"), F.max("sim").alias("confidence"), F.min("rank").alias("first"))
    best = F.max_by(F.struct("label", "score", "confidence"), F.struct(F.round("score", 12), -F.col("first")))
    return g.groupBy("query_id").agg(best.alias("x")).select("query_id", "x.*")


# --------------------------------------------------------------------- training
def training_set(ledger: DataFrame, labels: DataFrame, feedback: DataFrame) -> DataFrame:
    """(text, category): rule and code rows, overruled by labels (a machine's, then a person's, later ones winning), overruled by the latest corrections.

    ``ledger`` has id, natural_key, text, category, category_source. Empty texts and the default class don't teach.
    """
    ruled = ledger.where(F.col("category_source").isin("rule", "mcc")).select("text", "category", F.lit(0).alias("level"), F.col("id").cast("long").alias("at"))
    given = labels.select(F.col("text_norm").alias("text"), "category", F.when(F.col("source") == "manual", 2).otherwise(1).alias("level"), F.col("id").cast("long").alias("at"))
    last = feedback.groupBy("natural_key").agg(F.max_by("category", "id").alias("category"), F.max("id").alias("at"))
    fixed = last.join(ledger.select("natural_key", "text"), "natural_key").select("text", "category", F.lit(3).alias("level"), F.col("at").cast("long"))
    rows = ruled.unionByName(given).unionByName(fixed).where("text <> ''")
    best = rows.groupBy("text").agg(F.max_by("category", F.struct("level", "at")).alias("category"))
    return best.where(F.col("category") != V.DEFAULT)


def class_filter(rows: DataFrame, least: int = 5) -> DataFrame:
    """Classes with at least so many examples."""
    keep = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return rows.join(keep.select("category"), "category", "left_semi")


def split(rows: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Marks a stratified holdout: in each class the rows with the least seeded hash."""
    w = W.partitionBy("category")
    order = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "text").cast("binary")), "text"))
    return rows.withColumn("holdout", order <= F.round(F.count(F.lit(1)).over(w) * share))


def macro_f1(rows: DataFrame) -> DataFrame:
    """Accuracy and macro F1 of (actual, predicted) over all labels on either side."""
    cells = rows.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("a"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.lit(0).cast("long").alias("a"), F.col("n").alias("p")))).alias("s")).select("s.*")
    hits = cells.where("actual = predicted").select(F.col("actual").alias("label"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("p"))
    per = sides.unionByName(hits).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("a").alias("a"), F.sum("p").alias("p"))
    return per.agg((F.sum("tp") / F.sum("a")).alias("accuracy"), F.avg(F.when(F.col("a") + F.col("p") > 0, 2 * F.col("tp") / (F.col("a") + F.col("p"))).otherwise(0.0)).alias("macro_f1"), F.count(F.lit(1)).alias("n_labels"))


def promote(challenger: float, champion: float | None) -> bool:
    """A challenger that is at least as good takes over."""
    return champion is None or challenger >= champion


def trust(ledger: DataFrame, sample: int | None = None) -> DataFrame:
    """Share and mean confidence of each provenance, of the newest ``sample`` rows if given."""
    rows = ledger if sample is None else ledger.orderBy(F.col("value_date").desc(), F.col("natural_key").desc()).limit(sample)
    g = rows.groupBy("category_source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("category_confidence").cast("double")).alias("avg_confidence"))
    n = F.sum("n").over(W.partitionBy())  # a row for each of five provenances
    return g.select("category_source", "n", F.round(F.col("n") / n, 6).alias("share"), F.round("avg_confidence", 6).alias("avg_confidence"))


def labelling_queue(ledger: DataFrame, limit: int = 1000) -> DataFrame:
    """Distinct unresolved descriptions to label."""
    return ledger.where(F.col("category_source") == "default").select("description").where("description <> ''").distinct().orderBy("description").limit(limit)
