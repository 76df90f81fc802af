"""Queries about failures, issue messages, merged answers, generated reviews and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions.money import MONEY, money_text
from parchmint.operators import answers, evaluate, failures, reviews, validate
from parchmint.operators.assemble import completed
from parchmint.operators.extract import field
from parchmint.operators.score import scored
from parchmint.sources import calls
from parchmint.sources.render import cents, printed

from .catalog import _SENTENCES, query, table

_STATUS = "[400, 400, 400, 415, 413, 422, 502, 502, 504, 503, 502, 502, 502, 502, 503, 401, 413, 429, 500, 500, 500, 500]"


@query(f"""SELECT event_id AS id, {_STATUS}[event_id % 22 + 1] AS status, event_id % 22 IN (8, 9, 12) AS retryable, least(8.0, 0.5 * pow(2, event_id % 6))::DOUBLE AS wait FROM events""")
def failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every code there is."""
    i = F.col("event_id")
    code = F.get(F.array(*map(F.lit, failures.CODES)), (i % len(failures.CODES)).cast("int"))
    return table(spark, sf, "events").select(i.alias("id"), failures.status(code).alias("status"), failures.retryable(code).alias("retryable"), failures.longest_wait(i % 6).alias("wait"))


class _Reader:
    """A provider that fails by the document's number: for a while, for ever, or for the document's sake."""

    def __init__(self) -> None:
        self.tries: dict[int, int] = {}

    def __call__(self, request: dict) -> list[dict]:
        i = request["doc_id"]
        before = self.tries.get(i, 0)
        self.tries = {i: before + 1}
        if i % 11 == 0:
            raise calls.Failure("INVALID_IMAGE")
        if i % 13 == 0:
            raise calls.Failure("PROVIDER_UNAVAILABLE")
        if i % 17 == 0:
            raise ValueError("a bug")
        if i % 7 == 0 and before < i % 5:
            raise calls.Failure("OCR_TIMEOUT")
        return [{"text": f"TOTAL {i}", "confidence": 0.9, "bbox": None}]


def _second(request: dict) -> list[dict]:
    i = request["doc_id"]
    return [{"text": f"SECOND {i}", "confidence": None, "bbox": None}] if i % 2 == 0 else []


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'INVALID_IMAGE' WHEN o_orderkey % 13 = 0 THEN 'PROVIDER_UNAVAILABLE' WHEN o_orderkey % 17 = 0 THEN 'INTERNAL_ERROR' WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 > 2 THEN 'OCR_TIMEOUT' END AS one,
        o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AS late FROM orders),
    f AS (SELECT *, coalesce(one IN ('PROVIDER_UNAVAILABLE', 'OCR_TIMEOUT'), false) AS asked FROM o)
    SELECT id AS doc_id, CASE WHEN one IS NULL THEN 'TOTAL ' || id WHEN asked AND id % 2 = 0 THEN 'SECOND ' || id END AS line, CASE WHEN asked THEN CASE WHEN id % 2 = 1 THEN 'OCR_EMPTY_RESULT' END ELSE one END AS error,
        CASE WHEN asked THEN 4 WHEN late THEN 1 + id % 5 ELSE 1 END::INT AS attempts, CASE WHEN one IS NULL THEN 'first' WHEN asked AND id % 2 = 0 THEN 'second' END AS served_by, CASE WHEN asked THEN one END AS first_error, (asked OR late AND id % 5 > 0) AS waited FROM f""")
def provider_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls about each order with two more tries and a second provider; nothing is slept away."""
    requests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    got = calls.recognised(requests, [("first", _Reader()), ("second", _second)], policy=calls.Policy(2, seed=7, sleep=float))
    return got.select("doc_id", F.get("lines", F.lit(0))["text"].alias("line"), "error", "attempts", "served_by", "first_error", (F.col("waited_ms") > 0).alias("waited"))


@query("""WITH c AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '(?i)<<<\\s*PRODUCT_DATA_(?:BEGIN|END)\\s*>>>', '[REDACTED_MARKER]', 'g') AS t FROM conversations)
    SELECT conv_id, turn, role, sha256('<<<PRODUCT_DATA_BEGIN>>>' || chr(10) || 'Product: Pan [REDACTED_MARKER] ' || conv_id || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Category: Kitchen' || chr(10) ELSE '' END || 'size: ' || turn
        || CASE WHEN role = 'user' THEN chr(10) || chr(10) || 'The customer''s own answers:' || chr(10) || '1. Q: How is it?' || chr(10) || '   A: ' || t ELSE '' END || chr(10) || '<<<PRODUCT_DATA_END>>>' || chr(10) || chr(10)
        || 'Write exactly ' || (turn % 5 + 1) || ' sentences in English.' || chr(10) || 'Tone: Even-handed. Note what works and what does not.' || CASE WHEN turn % 3 = 0 THEN chr(10) || 'Use exactly this rating: 4.' ELSE '' END) AS prompt FROM c""")
def review_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Requests to a writer about what customers said, forged marks replaced."""
    turn, none = F.col("turn"), F.lit(None)
    answers_ = F.when(F.col("role") == "user", F.array(F.struct(F.lit("How is it?").alias("question"), F.col("text").alias("answer")))).otherwise(F.array().cast("array<struct<question:string,answer:string>>"))
    product = F.concat(F.lit("Pan <<< product_data_END>>> "), F.col("conv_id").cast("string"))
    made = reviews.prompt(product, answers_, F.lit("balanced"), turn % 5 + 1, F.lit("English"), F.when(turn % 2 == 0, "Kitchen"), none.cast("string"), F.create_map(F.lit("size"), turn.cast("string")), F.when(turn % 3 == 0, 4))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.sha2(made, 256).alias("prompt"))


@query("""SELECT o_orderkey AS doc_id, concat_ws(';', CASE WHEN o_orderkey % 7 = 0 THEN 'currency:USD:EUR' END, CASE WHEN o_orderkey % 5 = 0 THEN 'total:' || o_totalprice::DECIMAL(18,2) || ':1.00' END) AS fields FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 12 = 1""")
def evaluation_failures(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with documents that are no exact match, in fields or in items."""
    k = F.col("doc_id")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), printed(F.col("o_totalprice")).alias("t"))
    told = lambda total, code: F.create_map(F.lit("total"), total, F.lit("currency"), code)
    pairs = rows.select("doc_id", told(F.col("t"), F.lit("USD")).alias("expected"), told(F.when(k % 5 == 0, "1.00").otherwise(F.col("t")), F.when(k % 7 == 0, "EUR").otherwise("usd")).alias("actual"))
    items = rows.select("doc_id", F.when(k % 12 == 1, 0.5).otherwise(1.0).alias("f1"))
    got = evaluate.failures(evaluate.field_scores(pairs, ("total", "currency")), pairs, items)
    return got.select("doc_id", F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["field"], f["expected"], f["actual"])), ";").alias("fields"))


@query("""WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, CASE WHEN l_quantity < 20 THEN 'OCR_TIMEOUT' WHEN l_quantity < 30 THEN 'INVALID_IMAGE' END AS code FROM lineitem),
    f AS (SELECT id, min(i) AS attempts FROM l WHERE code IS NULL OR code <> 'OCR_TIMEOUT' OR i = 3 OR i = n GROUP BY id),
    g AS (SELECT f.id, attempts, code AS one FROM f JOIN l ON l.id = f.id AND l.i = attempts)
    SELECT id, attempts, CASE WHEN one IS NULL THEN 'first' WHEN one = 'OCR_TIMEOUT' AND id % 2 = 0 THEN 'second' END AS served_by, CASE WHEN one = 'OCR_TIMEOUT' THEN CASE WHEN id % 2 = 1 THEN 'OCR_EMPTY_RESULT' END ELSE one END AS code FROM g""")
def retried_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls with up to two more tries, then a second provider that finds nothing for odd orders."""
    q = F.col("l_quantity")
    code = F.when(q < 20, "OCR_TIMEOUT").when(q < 30, "INVALID_IMAGE")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", code.alias("code")))).alias("l"))
    rows = rows.withColumn("a", failures.attempted(F.transform("l", lambda x: x["code"]), 2)).withColumn("s", failures.served(F.col("a.code"), F.when(F.col("id") % 2 == 1, "OCR_EMPTY_RESULT")))
    return rows.select("id", F.col("a.attempts").alias("attempts"), F.col("s.by").alias("served_by"), F.col("s.code").alias("code"))


@query("""WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS i FROM lineitem JOIN part ON p_partkey = l_partkey),
    a AS (SELECT id, count(*) FILTER (WHERE i % 4 <> 2) AS good, count(*) FILTER (WHERE i % 4 NOT IN (1, 2)) AS priced, string_agg(CASE i % 4 WHEN 2 THEN 'items:ungrounded_description' WHEN 1 THEN 'items:ungrounded_price' END, ',' ORDER BY i) AS turned FROM l GROUP BY id),
    b AS (SELECT id, good, priced, turned, id % 4 AS k, id % 5 = 0 AS own, o_totalprice::DECIMAL(18,2) AS t, CASE WHEN id % 11 = 0 THEN 'LLM_TIMEOUT' WHEN id % 13 = 0 THEN 'LLM_OUTPUT_TRUNCATED' END AS failure FROM a JOIN orders ON o_orderkey = id)
    SELECT id, failure, CASE WHEN k = 0 THEN '1.00' WHEN k = 1 AND failure IS NULL THEN t::VARCHAR END AS tax,
        CASE WHEN own THEN 1 WHEN failure IS NULL THEN good ELSE 0 END::BIGINT AS n_items, CASE WHEN own OR failure IS NOT NULL THEN 0 ELSE priced END::BIGINT AS priced,
        CASE WHEN failure IS NOT NULL THEN '' ELSE concat_ws(',', CASE k WHEN 2 THEN 'tax.total:unparseable' WHEN 3 THEN 'tax.total:ungrounded' END, CASE WHEN NOT own THEN turned END) END AS rejected,
        CASE WHEN failure IS NOT NULL OR (k <> 1 AND (own OR good = 0)) THEN 'unused' WHEN id % 10 < 5 THEN 'discarded' ELSE 'applied' END AS verdict FROM b""")
def merged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Tax and items of a model's answer about each order, some of them made up, cut or failed."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    one = F.struct("l_linenumber", "l_partkey", "l_extendedprice", F.col("p_name").alias("name"), money_text(cents(F.col("l_extendedprice"))).alias("price"), F.col("l_quantity").cast("string").alias("n"))
    rows = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("l")).join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("id"))
    null, id_, shown = F.lit(None).cast("string"), F.col("id"), printed(F.col("o_totalprice"))
    said = F.transform("l", lambda x, i: F.struct(F.when(i % 4 == 2, "zz unseen qq").otherwise(x["name"]).alias("description"), null.alias("sku"), x["n"].alias("quantity"), null.alias("unit_price"), F.when(i % 4 == 1, "99999999.99").otherwise(x["price"]).alias("total_price")))
    claim = F.when(id_ % 4 == 2, "no idea").when(id_ % 4 == 3, F.concat(shown, F.lit("77"))).otherwise(shown)
    text = F.concat(F.array_join(F.transform("l", lambda x: F.concat_ws(" ", x["name"], x["price"])), "\n"), F.lit("\nTAX "), shown)
    own = F.array(F.struct(F.lit("Soap").alias("description"), null.alias("sku"), null.alias("quantity"), null.alias("unit_price"), null.alias("total_price"))).cast(f"array<{answers.ITEM}>")
    docs = rows.select("id", F.when(id_ % 4 == 0, 1).cast(MONEY).alias("tax"), F.when(id_ % 5 == 0, own).alias("items"), text.alias("document"), F.struct(claim.alias("tax_total"), said.alias("items")).alias("answer"), F.when(id_ % 11 == 0, "LLM_TIMEOUT").alias("error"), F.when(id_ % 13 == 0, "length").otherwise("stop").alias("finish"))
    got = answers.merge_answers(docs)
    priced = F.size(F.filter("items", lambda x: x["total_price"].isNotNull())).cast("long")
    merged = (id_ % 10).cast("double") / 10
    return got.select("id", "failure", money_text(F.col("tax")).alias("tax"), F.size("items").cast("long").alias("n_items"), priced.alias("priced"), F.array_join("rejected", ",").alias("rejected"), answers.verdict(F.col("used"), F.lit(0.5), merged).alias("verdict"))


#: Scores of fields by the rules, from the lines' score c: with the prior of the method, in weights 0.45 and 0.55.
_BY = {"kw": "(0.45 * c + 0.55 * 0.95)", "name": "(0.45 * c + 0.55 * 0.6)", "llm": "(0.45 * c + 0.55 * 0.7)", "poor": "(0.45 * 0.3 + 0.55 * 0.6)"}


def _overall(total: str, right: str) -> str:
    """SQL of the overall score of a name, a subtotal, a tax and a total of that score (null: no total), right or not."""
    part = f"least(1.0, {_BY['kw']} * CASE WHEN {right} THEN 1.08 ELSE 1.0 END)"
    own = f"least(1.0, ({total}) * CASE WHEN {right} THEN 1.08 ELSE 0.55 END)"
    return f"((2 * {_BY['name']} + 3 * {part} + CASE WHEN ({total}) IS NULL THEN 0 ELSE 3 * {own} END) / CASE WHEN ({total}) IS NULL THEN 5 ELSE 8 END)"


_RULES = _overall(f"CASE k WHEN 0 THEN NULL WHEN 1 THEN {_BY['kw']} WHEN 2 THEN {_BY['poor']} ELSE {_BY['kw']} END", "k <> 1")
_SECOND = _overall(_BY["llm"], "k <> 2")


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_totalprice::DECIMAL(18,2) AS t, o_orderkey % 4 AS k, 0.5 + (o_orderkey % 45) / 97 AS c,
        CASE WHEN o_orderkey % 11 = 0 THEN 'LLM_TIMEOUT' WHEN o_orderkey % 17 = 0 THEN 'LLM_INVALID_OUTPUT' WHEN o_orderkey % 13 = 0 THEN 'LLM_OUTPUT_TRUNCATED' END AS failure FROM orders),
    s AS (SELECT *, {_RULES} AS rules, {_SECOND} AS second, failure IS NULL AND (k IN (0, 2) OR k = 1 AND least(1.0, {_BY['kw']} * 0.55) < 0.75) AS used FROM o),
    v AS (SELECT *, CASE WHEN NOT used THEN 'unused' WHEN second < rules THEN 'discarded' ELSE 'applied' END AS verdict FROM s)
    SELECT id, failure, verdict, CASE WHEN verdict = 'applied' THEN CASE WHEN k = 2 THEN 2 * t ELSE t END WHEN k = 1 THEN 2 * t WHEN k IN (2, 3) THEN t END::DECIMAL(18,2)::VARCHAR AS total,
        round(CASE WHEN verdict = 'applied' THEN second ELSE rules END, 6)::DOUBLE AS overall, CASE WHEN used THEN 'total' ELSE '' END AS filled,
        CASE WHEN failure IS NULL AND k = 3 THEN 'merchant.phone:unparseable,receipt_number:ungrounded' ELSE '' END AS rejected, (CASE WHEN verdict = 'applied' THEN k = 2 ELSE k = 1 END)::INT AS errors FROM v""")
def second_opinions(spark: SparkSession, sf: str) -> DataFrame:
    """Raw answers of a model about each order's total: one that is absent, wrong, poorly read or sure; both versions validated and scored."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), cents(F.col("o_totalprice")).alias("t"))
    k, c, t = F.col("id") % 4, F.lit(0.5) + (F.col("id") % 45) / 97, F.col("t")
    sub = F.round(t / F.lit("1.1").cast("decimal(2,1)"), 2).cast(MONEY)
    low, twice, none = F.lit(0.3), (2 * t).cast(MONEY), F.lit(None).cast("string")
    shown = lambda x: money_text(x.cast(MONEY))
    total = F.when(k == 1, field(twice, "KEYWORD_ANCHORED", c, none)).when(k == 2, field(t.cast(MONEY), "HEURISTIC", low, none)).when(k == 3, field(t.cast(MONEY), "KEYWORD_ANCHORED", c, none))
    text = F.concat(F.lit("STORE\nSUBTOTAL "), shown(sub), F.lit("\nTAX "), shown(t - sub), F.lit("\nTOTAL "), shown(t), F.lit("\nPAID "), shown(twice))
    docs = rows.select("id", "t", field(F.lit("STORE"), "HEURISTIC", c, none).alias("merchant_name"), field(sub, "KEYWORD_ANCHORED", c, none).alias("subtotal"), field((t - sub).cast(MONEY), "KEYWORD_ANCHORED", c, none).alias("tax"), total.alias("total"), text.alias("full_text"), c.alias("mean_confidence"), F.lit(1).alias("measured"), F.lit(1).alias("geometry"), F.lit(5).alias("line_count"))
    said = F.to_json(F.struct(F.when(k == 2, shown(twice)).otherwise(shown(t)).alias("total"), F.lit("n/a").alias("currency"), F.when(k == 3, 5550123).alias("merchant_phone"), F.when(k == 3, "Q99Z").alias("receipt_number")))
    said = F.when(F.col("id") % 17 == 0, F.substr(said, F.lit(1), F.lit(14))).when(F.col("id") % 7 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said)
    docs = completed(docs).withColumns({"answer": said, "error": F.when(F.col("id") % 11 == 0, "LLM_TIMEOUT"), "finish": F.when(F.col("id") % 13 == 0, "length").otherwise("stop")})
    got = answers.second_opinion(scored(validate.validated(docs)))
    errors = F.size(validate.of_severity(F.col("issues"), "ERROR"))
    return got.select("id", "failure", "verdict", money_text(validate.amount("total")).alias("total"), F.round("confidence.overall", 6).alias("overall"), F.array_join("filled", ",").alias("filled"), F.array_join("rejected", ",").alias("rejected"), errors.alias("errors"))


@query(f"""SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 'Review of Item ' || conv_id ELSE 'T' || turn END AS title, CASE WHEN len({_SENTENCES}) <= 2 THEN text ELSE array_to_string(({_SENTENCES})[1:2], ' ') END AS body,
    least(len({_SENTENCES}), 2) AS n, greatest(1, least(5, turn + 3))::INT AS rating, role <> 'user' AS ai_generated FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations) WHERE text <> ''""")
def generated_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a model about a product: title, two sentences, rating and who vouches for it."""
    turn, user = F.col("turn"), F.col("role") == "user"
    made = reviews.generated(F.concat(F.lit("Item "), F.col("conv_id")), F.when(user, F.array("text")).otherwise(F.array().cast("array<string>")), 2, F.lit(None).cast("int"), F.when(turn % 2 == 0, "null").otherwise(F.concat(F.lit("T"), turn)), F.col("text"), (turn + 3).cast("string"))
    rows = table(spark, sf, "conversations").withColumn("g", made).where("g.error is null")
    return rows.select("conv_id", "turn", "role", F.col("g.title").alias("title"), F.col("g.body").alias("body"), F.col("g.sentence_count").alias("n"), F.col("g.rating").alias("rating"), F.col("g.ai_generated").alias("ai_generated"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_totalprice::DECIMAL(18,2) AS t, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(18,2) AS raw, sum((l_extendedprice * l_tax)::DECIMAL(18,2))::DECIMAL(18,2) AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    p AS (SELECT id, t, x, CASE WHEN id % 3 <> 0 THEN raw END AS s, raw - id % 7 * 100 AS i, CASE WHEN id % 2 = 0 THEN 0 ELSE x END AS tax, x - id % 4 * 50 AS parts FROM o)
    SELECT id, list_filter([CASE WHEN abs(i - s) > greatest(0.05, abs(s) * 0.01) THEN 'subtotal: Sum of line items does not match the subtotal.' END,
        CASE WHEN s IS NULL AND tax = 0 AND abs(i - t) > greatest(0.05, abs(t) * 0.01) THEN 'total: Sum of line items does not match the total.' END,
        CASE WHEN s IS NOT NULL AND least(abs(s - t), abs(s + tax - t)) > greatest(0.05, abs(t) * 0.01) THEN 'total: Calculated total does not match the total printed on the receipt.' END,
        CASE WHEN s > t + greatest(0.05, abs(t) * 0.01) THEN 'subtotal: Subtotal is greater than the total but no discount was found.' END,
        CASE WHEN abs(t - 9 - t) > greatest(0.05, abs(t) * 0.01) THEN 'payment.amount_paid: Amount tendered minus change does not equal the total.' END,
        CASE WHEN abs(parts - tax) > greatest(0.05, abs(tax) * 0.01) THEN 'tax.total: Itemised tax lines do not sum to the reported tax total.' END], lambda c: c IS NOT NULL) AS told FROM p""")
def financial_messages(spark: SparkSession, sf: str) -> DataFrame:
    """What a user reads about sums of items, the total, tender and parts of the tax."""
    sums = [F.sum(cents(e)).cast("decimal(28,6)").alias(n) for n, e in (("raw", F.col("l_extendedprice")), ("x", F.col("l_extendedprice") * F.col("l_tax")))]
    per = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(*sums)
    rows = per.join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("id"))
    id_, money = F.col("id"), lambda x: x.cast(MONEY)
    t = money(cents(F.col("o_totalprice")))
    tax = F.when(id_ % 2 == 0, money(F.lit(0))).otherwise(money(F.col("x")))
    rows = rows.select("id", t.alias("t"), F.when(id_ % 3 != 0, money(F.col("raw"))).alias("s"), money(F.col("raw") - id_ % 7 * 100).alias("i"), tax.alias("tax"), money(F.col("x") - id_ % 4 * 50).alias("parts"))
    c, none = F.col, F.lit(None).cast(MONEY)
    issues = validate.financial_issues(c("s"), c("t"), c("tax"), none, F.lit(0).cast(MONEY), c("i"), c("t"), F.lit(9).cast(MONEY), c("parts"), F.lit(2))
    return rows.select("id", F.transform(F.array_compact(F.array(*issues)), lambda x: F.concat(x["field"], F.lit(": "), x["message"])).alias("told"))


@query("""SELECT count(*) AS documents, round(avg((o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)::INT), 4) AS exact_match_rate, round(avg(CASE WHEN o_orderkey % 7 = 0 THEN 0.5 ELSE 1.0 END), 4) AS mean_item_f1,
    sum((o_orderkey % 5 = 0 OR o_orderkey % 7 = 0)::INT)::BIGINT AS failures, avg((o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)::INT) >= 0.9 AS passed FROM orders""")
def evaluation_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A report over all orders and whether it passes a least rate of exact matches."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(k.alias("doc_id"))
    scores = orders.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), right.alias("correct"), F.lit(False).alias("both_absent")) for f, right in (("total", F.col("doc_id") % 5 != 0), ("date", F.lit(True)))])).alias("s")).select("doc_id", "s.*")
    items = orders.select("doc_id", F.when(F.col("doc_id") % 7 == 0, 0.5).otherwise(1.0).alias("f1"))
    return evaluate.gate(evaluate.summary(scores, items), 0.9).select("documents", "exact_match_rate", "mean_item_f1", "failures", "passed")
