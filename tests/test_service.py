"""Failures, merged answers, reviews, uploads and the response, on rows written here."""

import json

from pyspark.sql import functions as F

from parchmint.config import Settings
from parchmint.operators import answers, evaluate, failures, reviews, validate
from parchmint.operators.assemble import envelope, processing
from parchmint.sources.recorded import upload_error, uploads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def codes(*values):
    return F.array(*[F.lit(v).cast("string") for v in values])


def test_tries(spark):
    t = lambda *v: tuple(one(spark, failures.attempted(codes(*v), 2)))
    assert t(None) == (1, None) and t("OCR_TIMEOUT", None, "OCR_TIMEOUT") == (2, None)
    assert t("OCR_FAILED", None) == (1, "OCR_FAILED")
    assert t(*["LLM_TIMEOUT"] * 5) == (3, "LLM_TIMEOUT") and t("OCR_TIMEOUT") == (1, "OCR_TIMEOUT")
    assert [one(spark, failures.longest_wait(F.lit(i))) for i in (0, 1, 9)] == [0.5, 1.0, 8.0]
    assert one(spark, failures.status(F.lit("SOMETHING"))) == 500 and one(spark, failures.status(F.lit(None).cast("string"))) is None


def test_second_provider_only_for_failures_of_the_first(spark):
    s = lambda a, b: tuple(one(spark, failures.served(F.lit(a).cast("string"), F.lit(b).cast("string"))))
    assert s(None, "OCR_FAILED") == ("first", None) and s("OCR_EMPTY_RESULT", None) == ("second", None)
    assert s("INVALID_IMAGE", None) == (None, "INVALID_IMAGE") and s("OCR_TIMEOUT", "OCR_FAILED") == (None, "OCR_FAILED")


def test_answers(spark):
    docs = spark.sql("SELECT CAST(null AS decimal(28,6)) AS tax, CAST(null AS string) AS text").withColumn("items", F.array().cast(f"array<{answers.ITEM}>"))
    said = '{"tax_total": "1.20", "items": [{"description": "Soap", "total_price": "3.00"}, {"description": "n/a", "total_price": "3.00"}, {"description": "Bread", "total_price": "9.99"}]}'
    docs = docs.withColumns({"document": F.lit("Soap 3.00 / BREAD 4.00 / VAT 1.20"), "answer": F.from_json(F.lit(said), answers.ANSWER), "error": F.lit(None).cast("string"), "finish": F.lit("stop")})
    got = answers.merge_answers(docs).first()
    assert float(got["tax"]) == 1.2 and got["used"] and got["filled"] == ["tax.total", "items"]
    assert [(x["description"], x["total_price"] and float(x["total_price"])) for x in got["items"]] == [("Soap", 3.0), ("Bread", None)]
    assert got["rejected"] == ["items:ungrounded_description", "items:ungrounded_price"]
    cut = answers.merge_answers(docs.withColumn("finish", F.lit("length"))).first()
    assert (cut["failure"], cut["used"], cut["tax"], cut["items"]) == ("LLM_OUTPUT_TRUNCATED", False, None, [])
    none = answers.merge_answers(docs.withColumn("answer", F.from_json(F.lit(None).cast("string"), answers.ANSWER))).first()
    assert not none["used"] and none["rejected"] == []


def test_reviews(spark):
    text = lambda x: F.lit(x).cast("string")
    made = lambda body, *a: one(spark, reviews.generated(F.lit("Pan"), codes(*a) if a else F.array().cast("array<string>"), 1, F.lit(None).cast("int"), text(None), text(body), text("9")))
    good = made("Fine.  It lasts. ", "I used it")
    assert (good["title"], good["body"], good["sentence_count"], good["rating"], good["ai_generated"], good["error"]) == ("Review of Pan", "Fine.", 1, 5, False, None)
    assert good["disclosure"] == reviews.OWN_WORDS and made("Fine.")["disclosure"] == reviews.MADE_UP
    assert [made(b)["error"] for b in (None, "", "n/a")] == [reviews.NO_OUTPUT] * 3
    assert one(spark, reviews.questions_error(codes(None, " "), 3)) == reviews.NO_OUTPUT and one(spark, reviews.questions_error(codes("Why?"), 3)) is None
    assert one(spark, reviews.tone_guidance(F.lit("Critical"))) == reviews.TONES["critical"]


def test_uploads_tell_what_is_wrong(spark, tmp_path):
    for name, size in (("a.png", 3), ("c.png", 11)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r["path"][-5:]: (r["length"], r["content"] and len(r["content"]), r["error"]) for r in uploads(spark, str(tmp_path), 10).collect()}
    assert got == {"a.png": (3, 3, None), "c.png": (11, None, "IMAGE_TOO_LARGE")}
    assert [one(spark, upload_error(F.lit(n), 10)) for n in (0, 10, 11)] == ["EMPTY_FILE", None, "IMAGE_TOO_LARGE"]


def test_messages_reach_the_response(spark):
    issues = F.array(validate.issue("FUTURE_DATE", "WARNING", "transaction.date"), validate.issue("NEGATIVE_TOTAL", "ERROR", "total"), validate.issue("MISSING_SUBTOTAL", "INFO", "subtotal"))
    body = json.loads(one(spark, envelope(F.struct(F.lit(1).alias("total")), issues, made=processing(F.lit("r1"), F.lit(1.234)))))
    assert [list(w) for w in body["warnings"]] == [["code", "message", "field"]] * 2
    assert [w["message"] for w in body["warnings"]] == ["Total is negative; the document may be a refund or was misread.", "Transaction date is in the future."]
    assert body["success"] and body["errors"] == [] and body["processing"]["request_id"] == "r1" and body["processing"]["processing_time_ms"] == 1.23
    bad = json.loads(one(spark, envelope(F.struct(F.lit(1).alias("total")), issues, F.lit("OCR_TIMEOUT"), F.lit("Too slow."))))
    assert (bad["success"], bad["data"], bad["errors"]) == (False, None, [{"code": "OCR_TIMEOUT", "message": "Too slow.", "field": None}])


def test_items_must_match_for_an_exact_document(spark):
    scores = spark.createDataFrame([(1, "total", True, False), (2, "total", True, False), (3, "total", False, False)], "doc_id long, field string, correct boolean, both_absent boolean")
    items = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, 1.0)], "doc_id long, f1 double")
    got = evaluate.gate(evaluate.summary(scores, items), 0.5).first()
    assert (got["exact_match_rate"], got["failures"], got["passed"]) == (0.3333, 2, False)


def test_settings_from_the_environment():
    got = Settings.from_environment({"PARCHMINT_REDACT": "false", "PARCHMINT_LLM_THRESHOLD": "0.5", "PARCHMINT_TODAY": "2026-01-01", "OTHER": "x"})
    assert (got.redact, got.llm_threshold, got.today, got.weight_ocr) == (False, 0.5, "2026-01-01", 0.45)


def test_a_document_is_made_bare_once(spark):
    docs = spark.sql("SELECT CAST(null AS decimal(28,6)) AS tax, 'Soap 3.00' AS document, CAST(null AS string) AS error, 'stop' AS finish").withColumn("items", F.array().cast(f"array<{answers.ITEM}>"))
    docs = docs.withColumn("answer", F.from_json(F.lit('{"items": [{"description": "Soap", "total_price": "3.00"}]}'), answers.ANSWER))
    plan = answers.merge_answers(docs.repartition(1))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(document") == 1  # it was once for each look into it, within the loop over items
    assert answers.merge_answers(docs).first()["items"][0]["description"] == "Soap"


def test_an_error_has_every_key_of_the_contract(spark):
    bad = json.loads(one(spark, envelope(F.struct(F.lit(1).alias("total")), F.array().cast(f"array<{validate.ISSUE}>"), F.lit("OCR_TIMEOUT"), F.lit("Too slow."), details=F.lit(None).cast("map<string,string>"))))
    assert bad["errors"] == [{"code": "OCR_TIMEOUT", "message": "Too slow.", "field": None, "details": None}]
