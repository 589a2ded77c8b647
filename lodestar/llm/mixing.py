"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are aggregated to token counts of (source, language, topic) cells.
Raking multiplies the cells' weights until the weighted tokens meet the targets
of all three margins; documents are then sampled with probabilities that are
proportional to their cell's weight and calibrated to a token budget.

The cells of a source are one row. Given the factors of languages and topics, a
source's factor is an expression of its own row, so a round is one aggregation
to (language, topic) sums; languages and topics are few (topics are a
parameter), and only their factors come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.runtime import BROADCAST_ROWS, dropped, numbered, small_or_shuffled, written

#: Topics by the strings that mark them; the first that fits counts, ``prose`` where none does.
TOPICS = (("licence", ("License", "CC BY")), ("table", (" | ",)), ("noisy", ("%%%", "***", "###")))
#: Exponents: a margin's target shares are its token shares to this power, made to sum to one.
SOURCE_POWER, LANG_POWER, TOPIC_POWER = 0.5, 0.7, 0.8
#: Rounds of raking, and the part of all tokens that a sample shall have.
ROUNDS, BUDGET, SEED = 12, 0.6, 42
#: Most (language, topic) pairs whose sums a round may bring to the driver; with more, factors are joined to the cells.
PAIRS = 100_000
_NONE = "∅"


def topic_of(text: str = "text", topics=TOPICS) -> Column:
    out = F.lit("prose")
    for name, marks in reversed(topics):
        fits = F.lit(False)
        for m in marks:
            fits = fits | F.contains(F.col(text), F.lit(m))
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def tokens_of(text: str = "text") -> Column:
    """A quarter of a text's characters, rounded up; null has none."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def uniform(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that a row's id and the seed decide."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _doubles(values: list[float]) -> Column:
    """A literal array of doubles that the optimizer folds once."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _shares(sums: dict, power) -> dict:
    """Target share by value: an exponent of the present shares, or shares by value (unlisted values keep theirs)."""
    total = sum(sums.values()) or 1.0
    if not isinstance(power, dict):
        raised = {k: (v / total) ** power if v else 0.0 for k, v in sums.items()}
        whole = sum(raised.values()) or 1.0
        return {k: v / whole for k, v in raised.items()}
    kept = {k: v / total for k, v in sums.items() if k not in power}
    listed = sum(v for k, v in power.items() if k in sums) or 1.0
    return kept | {k: power[k] / listed * (1 - sum(kept.values())) for k in sums if k in power}


def rake(cells: DataFrame, source_power: float = SOURCE_POWER, lang_target=LANG_POWER, topic_target=TOPIC_POWER, rounds: int = ROUNDS) -> DataFrame:
    """``(source, lang, topic, tokens, weight)`` of the cells with raked weights.

    ``cells`` has one row a cell, without nulls. Sources take an exponent;
    languages and topics an exponent or a dict of shares. Cells without tokens
    keep weight one.
    """
    pair_sums = {(r["lang"], r["topic"]): float(r["t"]) for r in cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("t")).limit(PAIRS + 1).collect()}
    if len(pair_sums) > PAIRS:
        return _rake_joined(cells, {"source": source_power, "lang": lang_target, "topic": topic_target}, rounds)
    pairs = sorted(pair_sums)
    total = sum(pair_sums.values())
    if not total:
        return cells.withColumn("weight", F.lit(1.0))
    langs, topics = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
    lang_share = _shares({a: sum(v for (x, _), v in pair_sums.items() if x == a) for a in langs}, lang_target)
    topic_share = _shares({b: sum(v for (_, y), v in pair_sums.items() if y == b) for b in topics}, topic_target)

    number = F.array_position(F.array(*[F.lit(f"{a}\x00{b}") for a, b in pairs]), F.concat("lang", F.lit("\x00"), "topic")).cast("int")
    # a source has at most one entry for each of the bounded pairs
    rows = cells.withColumn("i", number).groupBy("source").agg(F.sum("tokens").cast("double").alias("t"), F.sort_array(F.collect_list(F.struct("i", "lang", "topic", "tokens"))).alias("cells"))
    powers = rows.agg(F.sum(F.when(F.col("t") > 0, F.pow(F.col("t") / total, F.lit(source_power))))).first()[0]
    rows = written(rows.withColumn("goal", F.when(F.col("t") > 0, F.pow(F.col("t") / total, F.lit(source_power)) / powers * total).otherwise(0.0)), "mix-cells")

    f_lang, f_topic = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    for _ in range(rounds):
        now = _factored(rows, pairs, f_lang, f_topic)
        got = {r["i"]: r["s"] for r in now.groupBy(F.col("c.i").alias("i")).agg(F.sum(F.col("f") * F.col("c.tokens")).alias("s")).collect()}
        sums = {p: got.get(k + 1, 0.0) for k, p in enumerate(pairs)}
        last = dict(f_topic)
        for a in langs:
            s = sum(v * last[y] for (x, y), v in sums.items() if x == a)
            f_lang[a] = lang_share[a] * total / s if s else 1.0
        for b in topics:
            s = sum(v * f_lang[x] for (x, y), v in sums.items() if y == b)
            f_topic[b] = topic_share[b] * total / s if s else 1.0
    out = _factored(rows, pairs, f_lang, f_topic)  # sources are fitted last
    weight = F.when(F.col("c.tokens") > 0, F.col("f") * F.col("g")).otherwise(1.0)
    return out.select("source", "c.lang", "c.topic", "c.tokens", weight.alias("weight"))


def _goals(cells: DataFrame, margin: str, target) -> DataFrame:
    """``(margin, goal)``: the tokens that each value of a margin shall have, as ``_shares`` has them."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t"))
    whole = F.broadcast(sums.agg(F.sum("t").alias("total")))  # one row
    if not isinstance(target, dict):
        raised = F.when(F.col("t") > 0, F.pow(F.col("t") / F.col("total"), F.lit(target))).otherwise(0.0)
        rows = sums.crossJoin(whole).withColumn("p", raised)
        return rows.crossJoin(F.broadcast(rows.agg(F.sum("p").alias("q")))).select(margin, (F.col("p") / F.col("q") * F.col("total")).alias("goal"))
    listed = F.element_at(F.create_map(*[F.lit(x) for kv in target.items() for x in kv]), F.col(margin))
    rows = sums.crossJoin(whole).withColumn("p", listed)
    rest = rows.agg(F.sum("p").alias("q"), F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("t"))), F.lit(0.0)).alias("kept"))
    goal = F.when(F.col("p").isNull(), F.col("t")).otherwise(F.col("p") / F.col("q") * (F.col("total") - F.col("kept")))
    return rows.crossJoin(F.broadcast(rest)).select(margin, goal.alias("goal"))


def _rake_joined(cells: DataFrame, targets: dict, rounds: int) -> DataFrame:
    """``rake`` for any number of pairs: each margin's factors are joined to the cells, which are written each round."""
    goals = {k: written(_goals(cells, k, t), "mix-goals") for k, t in targets.items()}
    now = cells.select("source", "lang", "topic", "tokens", F.lit(1.0).alias("weight"))

    def fitted(now: DataFrame, margin: str) -> DataFrame:
        held = now.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("weight")).alias("held")).join(goals[margin], margin)
        factor = held.select(margin, F.when(F.col("held") > 0, F.col("goal") / F.col("held")).otherwise(1.0).alias("factor"))
        return now.join(small_or_shuffled(factor), margin).select("source", "lang", "topic", "tokens", (F.col("weight") * F.col("factor")).alias("weight"))

    for r in range(rounds + 1):
        for margin in targets if r < rounds else ["source"]:
            after = written(fitted(now, margin), "mix-fitted")
            dropped(now)
            now = after
    return now.withColumn("weight", F.when(F.col("tokens") > 0, F.col("weight")).otherwise(1.0))


def _factored(rows: DataFrame, pairs: list, f_lang: dict, f_topic: dict) -> DataFrame:
    """Cells ``c`` of each source with the source's factor ``f`` and the pair's ``g``."""
    g = _doubles([f_lang[a] * f_topic[b] for a, b in pairs])
    held = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["tokens"] * F.element_at(g, c["i"]))
    out = rows.withColumn("f", F.when(held > 0, F.col("goal") / held).otherwise(1.0)).select("source", "f", F.explode("cells").alias("c"))
    return out.withColumn("g", F.element_at(g, F.col("c.i")))


def calibrated(cells: DataFrame, budget: float = BUDGET, rounds: int = 12) -> DataFrame:
    """Cells with ``probability``: ``min(1, c * weight)``, ``c`` such that the expected tokens are ``budget`` of all.

    Each round takes the cells that reach one out of the sum; it ends when none is new.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    c, capped = 0.0, -1
    for _ in range(rounds):
        full = F.col("weight") * F.lit(c) >= 1
        r = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("done"), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if not r["open"] or r["n"] == capped:
            break
        c, capped = max(0.0, budget * total - r["done"]) / r["open"], r["n"]
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(c)) if total else F.lit(1.0))


def _decided(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, budget: float, seed: int, rounds: int, topics, targets: dict) -> DataFrame:
    """``docs`` under numbered names, with ``_source``, ``_lang`` and the columns of ``mixed``."""
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    id_col, text_col, source_col, lang_col = (own[c] for c in (id_col, text_col, source_col, lang_col))
    label = numbered(docs).withColumns({"_source": F.coalesce(F.col(source_col), F.lit(_NONE)), "_lang": F.coalesce(F.col(lang_col), F.lit(_NONE)), "_topic": topic_of(text_col, topics), "_tokens": tokens_of(text_col)})
    label = label.withColumn("_topic", F.coalesce("_topic", F.lit("prose")))
    cells = written(label.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens")), "mix-counts")
    weights = written(rake(cells, rounds=rounds, **targets), "mix-weights")
    table = calibrated(weights, budget).select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("topic").alias("_topic"), F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    keys = ["_source", "_lang", "_topic"]
    if weights.count() <= BROADCAST_ROWS // 10:
        out = label.join(F.broadcast(table), keys)  # counted to be small
    else:  # a hot cell is spread over salts
        salts = 32
        spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = label.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")).join(spread, [*keys, "_salt"]).drop("_salt")
    return out.withColumn("_kept", uniform(id_col, seed) < F.col("_probability"))


#: Columns that ``mixed`` adds.
ADDED = ("_topic", "_tokens", "_weight", "_probability", "_kept")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", budget: float = BUDGET, seed: int = SEED, rounds: int = ROUNDS, topics=TOPICS, **targets) -> DataFrame:
    """``docs`` with ``_topic``, ``_tokens``, ``_weight``, ``_probability`` and ``_kept`` added (columns so named are replaced).

    A null source or language is a value of its own; null and empty texts have
    no tokens and their cell, if it has none else, weight one. A repeated id
    shares its fate. No rows in, no rows out.
    """
    out = _decided(docs, id_col, text_col, source_col, lang_col, budget, seed, rounds, topics, targets)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in ADDED], *ADDED)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", budget: float = BUDGET, seed: int = SEED, rounds: int = ROUNDS, topics=TOPICS, **targets) -> DataFrame:
    """The documents that ``mixed`` keeps, with the columns of ``docs``, whatever their names."""
    out = _decided(docs, id_col, text_col, source_col, lang_col, budget, seed, rounds, topics, targets)
    return out.filter("_kept").select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = mixed(docs)
    return out.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"), F.col("_kept").alias("kept"))


def sql(docs: str = "documents", rounds: int = ROUNDS, budget: float = BUDGET, seed: int = SEED) -> str:
    """The same in DuckDB SQL, raking unrolled."""
    topic = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(text, '{m}')''' for m in marks)} THEN '{name}'" for name, marks in TOPICS) + " ELSE 'prose' END"
    steps = [
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(source, '{_NONE}') AS s, coalesce(lang, '{_NONE}') AS l, {topic} AS t, coalesce(ceil(length(text) / 4), 0)::BIGINT AS n FROM {docs})",
        "c AS MATERIALIZED (SELECT s, l, t, sum(n)::DOUBLE AS n FROM d GROUP BY ALL)",
        "g AS MATERIALIZED (SELECT sum(n) AS total FROM c)",
    ]
    for k, power in (("s", SOURCE_POWER), ("l", LANG_POWER), ("t", TOPIC_POWER)):
        steps.append(f"g{k} AS MATERIALIZED (SELECT {k}, p / sum(p) OVER () * total AS goal FROM (SELECT {k}, CASE WHEN sum(n) > 0 THEN pow(sum(n) / any_value(total), {power}) ELSE 0 END AS p, any_value(total) AS total FROM c, g GROUP BY {k}))")
    steps.append("w0 AS MATERIALIZED (SELECT c.*, 1.0::DOUBLE AS fs, 1.0::DOUBLE AS fl, 1.0::DOUBLE AS ft FROM c)")
    at = 0
    for r in range(rounds + 1):
        for k in ("s", "l", "t") if r < rounds else ("s",):
            steps.append(
                f"w{at + 1} AS MATERIALIZED (SELECT s, l, t, n, {', '.join(f'f{j}' if j != k else f'CASE WHEN h > 0 THEN goal / h ELSE 1 END AS f{k}' for j in 'slt')} "
                f"FROM (SELECT w.*, goal, sum(n * {' * '.join(f'f{j}' for j in 'slt' if j != k)}) OVER (PARTITION BY {k}) AS h FROM w{at} w JOIN g{k} USING ({k})))"
            )
            at += 1
    steps.append(f"x0 AS MATERIALIZED (SELECT s, l, t, n, CASE WHEN n > 0 THEN fs * (fl * ft) ELSE 1 END AS w, 0.0::DOUBLE AS k FROM w{at})")
    for r in range(12):
        steps.append(f"x{r + 1} AS MATERIALIZED (SELECT s, l, t, n, w, coalesce(greatest(0, {budget} * sum(n) OVER () - sum(CASE WHEN w * k >= 1 THEN n ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN w * k >= 1 THEN 0 ELSE n * w END) OVER (), 0), k) AS k FROM x{r})")
    return (
        "WITH " + ",\n".join(steps) + "\n"
        f"SELECT doc_id, source, lang, t AS topic, d.n AS tokens, round(w, 6) AS weight, round(least(1, w * k), 6) AS probability, "
        f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 8))::UBIGINT / 4294967296.0 < least(1, w * k) AS kept "
        "FROM d JOIN x12 USING (s, l, t)"
    )


SQL = sql()
