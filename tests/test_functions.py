"""Scalar semantics: one table of cases for each function, run as one DataFrame."""

import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F


def run(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[1] for r in sorted(rows.select("i", f(F.col("v"))).collect())]


def test_folding_and_cleaning(spark):
    from parchmint.functions import text

    cases = {"“A” – b": '"A" - b', "１２．５": "12.5", "•x": "*x", "plain": "plain", "": "", "ﬁn": "fin"}
    assert run(spark, text.normalize_unicode, list(cases)) == list(cases.values())
    lines = {"  a \t b  ": "a b", "------x": "---x", "a....b": "a...b", "***": "***", "x\u200by": "x y"}
    assert run(spark, text.clean_line, [*lines, None]) == [*lines.values(), ""]


def test_numbers_are_repaired_and_words_survive(spark):
    from parchmint.functions import text

    cases = {"1O.99": "10.99", "$2S.OO,": "$25.00,", "COFFEE": "COFFEE", "B12": "B12", "LOSS 5": "LOSS 5", "A1B2C3": "A1B2C3", "1l x  l.5O": "11 x  1.50", "12.50": "12.50", "O.5": "0.5"}
    assert run(spark, text.normalize_numeric_tokens, list(cases)) == list(cases.values())
    assert run(spark, text.numeric_corrections, ["$1O.99, ok 2S"]) == [["1O.99->10.99", "2S->25"]]
    words = {"T0TAL": "TOTAL", "H2O": "H2O", "5UBTOTAL": "SUBTOTAL", "A1": "A1", "AB12": "AB12"}
    assert run(spark, text.repair_word, list(words)) == list(words.values())
    keys = {"T0TAL: ": "TOTAL", "T O T A L": "TOTAL", "Sub-Total  9%": "SUB TOTAL 9%", "": ""}
    assert run(spark, text.normalize_keyword_text, list(keys)) == list(keys.values())


def test_separators_and_noise(spark):
    from parchmint.functions import text

    cases = {": - 5.00": "5.00", "-5.00": "-5.00", " :# A= ": "A", "x - ": "x"}
    assert run(spark, text.strip_separators, list(cases)) == list(cases.values())
    noise = {"ok ===== ***": False, "a\ufffd": True, "¤¤¤¤¤¤¤¤¤¤": True, "": False}
    assert run(spark, text.has_suspicious_characters, list(noise)) == list(noise.values())


def python_canonical(digits, style):
    """An independent reading of one grouped number."""
    c = "".join(x for x in digits if x not in " '\u00a0\u202f\t")
    marks = [x for x in c if x in ".,"]
    if not marks:
        return c
    head, _, tail = c.rpartition(marks[-1])
    joined = "".join(x for x in c if x.isdigit())
    if len(set(marks)) == 2:
        return "".join(x for x in head if x.isdigit()) + "." + tail if marks.count(marks[-1]) == 1 else None
    if len(marks) > 1:
        return joined
    if len(tail) == 3:
        grouping = {"unknown": ".,", "comma_decimal": ".", "dot_decimal": ","}[style]
        return joined if marks[0] in grouping else f"{head}.{tail}"
    return f"{head}.{tail}" if len(tail) in (1, 2) else joined


def test_canonical_amounts_against_another_reading(spark):
    from parchmint.functions import money

    digits = ["1", "1.5", "1,5", "1.234", "1,234", "1.234,56", "1,234.56", "1 234,50", "1'234.5", "12.345.678", "0.999", "1,23", "12,345,678.9", "1.2345"]
    for style in ("unknown", "dot_decimal", "comma_decimal"):
        got = run(spark, lambda c: money.canonical(c, F.lit(style)), digits)
        assert got == [python_canonical(d, style) for d in digits]


def test_amounts(spark):
    from parchmint.functions import money

    cases = {"TOTAL 5.00": ("5.00", False), "(5.00)": ("-5.00", True), "-3,50": ("-3.50", True), "2.00-": ("-2.00", True), "none": None, "25-Aug": ("-25", True), "1O.99": ("10.99", False)}
    got = run(spark, lambda c: money.parse_amount(c), list(cases))
    assert [g and (g["value"], g["negative"]) for g in got] == [v and (Decimal(v[0]), v[1]) for v in cases.values()]
    assert [[a["value"] for a in x] for x in run(spark, lambda c: money.amounts(c, F.lit("unknown")), ["2 x 4.00  8.00", "x"])] == [[2, 4, 8], []]
    votes = run(spark, money.separator_votes, ["1,234.56", "1.234,56", "1,50 2,50", "1,234", "1.234", "7"])
    assert [(v["dot"], v["comma"]) for v in votes] == [(3, 0), (0, 3), (0, 2), (1, 0), (0, 1), (0, 0)]
    assert run(spark, money.parse_percentage, ["VAT 20% 4.00", "8,25 %", "no"]) == [20, Decimal("8.250"), None]
    assert run(spark, lambda c: money.money_text(c.cast("decimal(28,6)")), ["2.005", "-1.5", "3"]) == ["2.01", "-1.50", "3.00"]
    assert run(spark, lambda c: money.quantity_text(c.cast("decimal(18,6)")), ["2.500", "10", "0.75"]) == ["2.5", "10", "0.75"]


def test_dates(spark):
    from parchmint.functions import dates

    cases = {
        "2026-08-25": ("2026-08-25", None), "25/08/2026": ("2026-08-25", None), "08/25/26": ("2026-08-25", None), "08/09/26": (None, "AMBIGUOUS_DATE_FORMAT"),
        "25 Aug 2026": ("2026-08-25", None), "Aug 25, 2026": ("2026-08-25", None), "31/02/2026": (None, "INVALID_DATE"), "63/18/2026": ("2026-03-18", "OCR_DIGIT_REPAIRED"),
        "3/12.00": (None, "AMBIGUOUS_DATE_FORMAT"), "13/12.00": (None, "INVALID_DATE"), "01.13.1985": ("1985-01-13", "IMPLAUSIBLE_DATE"), "12 mrz 24": ("2024-03-12", None), "none": None,
    }
    got = run(spark, lambda c: dates.parse_date(c), list(cases))
    assert [g and (g["value"] and str(g["value"]), g["warning"]) for g in got] == list(cases.values())
    assert str(run(spark, lambda c: dates.parse_date(c, "DMY"), ["08/09/26"])[0]["value"]) == "2026-09-08"
    times = {"2:35 PM": "14:35:00", "12:05am": "00:05:00", "14h30": "14:30:00", "9.15 p.m.": "21:15:00", "23:59:58": "23:59:58", "25:10": None}
    assert [g["value"] for g in run(spark, dates.parse_time, list(times))] == list(times.values())


def test_currencies(spark):
    from parchmint.functions import currency

    def detect(c, **options):
        return currency.detect_currency(c, currency.find_codes(c), currency.find_symbols(c), **options)

    cases = {"EUR €5": ("EUR", 0.97, []), "€5": ("EUR", 0.92, []), "$5": (None, 0.0, ["AMBIGUOUS_CURRENCY"]), "SALES TAX $5": ("USD", 0.85, []), "no": (None, 0.0, ["MISSING_CURRENCY"]), "R$ 5": ("BRL", 0.92, ["MULTIPLE_CURRENCIES_DETECTED"]), "R-2026": (None, 0.0, ["MISSING_CURRENCY"]), "R 50": ("ZAR", 0.88, [])}
    assert [(g["code"], g["confidence"], g["warnings"]) for g in run(spark, detect, list(cases))] == list(cases.values())
    assert run(spark, lambda c: detect(c, country="CA"), ["$5"])[0]["code"] == "CAD"
    assert run(spark, lambda c: detect(c, default="CHF"), ["no"])[0]["confidence"] == 0.30


def test_identifiers(spark):
    from parchmint.functions import identifiers as own

    assert run(spark, own.phone, ["Tel: (555) 123-4567", "+1 555 123 4567", "5551234567", "TOTAL +15551234567", "TEL none"]) == ["5551234567", "+15551234567", None, None, None]
    assert run(spark, own.email, ["Mail A.B@Ex.COM!", "no"]) == ["a.b@ex.com", None]
    assert run(spark, own.website, ["see www.Shop.example.com, ok", "https://x.io/a?b", "a.b"]) == ["www.shop.example.com", "https://x.io/a?b", None]
    assert run(spark, own.receipt_number, ["Receipt No: A-12", "Beleg-Nr: 77", "Invoice ABC", "x"]) == ["A-12", "77", None, None]
    assert run(spark, own.tax_id, ["VAT 20%", "TIN: 12-3"]) == ["20", "12-3"]
    assert run(spark, own.card_type, ["paid MC", "American Express", "cash"]) == ["MASTERCARD", "AMEX", None]
    assert run(spark, own.auth_code, ["AUTH CODE: a1b2c3", "APPR # 12"]) == ["A1B2C3", None]
    assert run(spark, own.store_id, ["Oak Street", "Store #12", "STORE NO"]) == ["eet", "12", None]


def test_masking(spark):
    from parchmint.functions import security

    cases = {"card 4111 1111 1111 1111 ok": ("card ************1111 ok", 1, 0), "4465758382889437 446": ("4465758382889437 446", 0, 0), "1234567890123456": ("************3456", 1, 0), "CVV: 123": ("CVV ***", 0, 1), "123456789012": ("123456789012", 0, 0)}
    assert [tuple(g) for g in run(spark, security.redact, list(cases))] == list(cases.values())
    assert [tuple(g) for g in run(spark, security.redact, [None])] == [("", 0, 0)]
    names = {"../a b.png": "a_b.png", "C:\\x\\.y": "y", "...": None, "a" * 200 + ".jpeg": "a" * 123 + ".jpeg"}
    assert run(spark, security.sanitize_filename, list(names)) == list(names.values())


@pytest.mark.parametrize("text", ["TOTAL AMOUNT PAID 3", "SUB TOTAL 4", "GRAND TOTAL TAX", "CASH TENDERED VISA", "nothing"])
def test_labels_take_spans_by_category_first(spark, text):
    from parchmint.operators.lexicon import PATTERNS, find_labels
    import re

    spans = sorted((i, m.start() - m.end(), m.start(), c) for i, (c, p) in enumerate(PATTERNS.items()) for m in re.finditer(p.replace("(?U)", ""), text))
    chosen = []
    for _, shorter, start, category in spans:
        if all(start - shorter <= a or start >= b for a, b, _ in chosen):
            chosen.append((start, start - shorter, category))
    assert [(x["start"], x["end"], x["category"]) for x in run(spark, find_labels, [text])[0]] == sorted(chosen)


def test_vocabulary_is_normalised():
    from parchmint.operators.lexicon import VOCABULARY

    words = [w for own in VOCABULARY.values() for w in own]
    assert len(VOCABULARY) == 17 and len(words) == 274
    assert all(w == unicodedata.normalize("NFKC", w).upper() for w in words)


def test_holders_of_claims_equal_plain_search(spark):
    from parchmint.operators.gates import holders

    base = "abcdefghijklmnopqrstuvwxyz0123456789" * 2
    claims = [(1, base[3:40]), (2, base[5:12]), (3, "z"), (4, "notthere"), (5, ""), (6, base[:31]), (7, base[20:51]), (8, "qq" * 30)]
    docs = [(10, base), (11, "x" + base[4:60]), (12, ""), (13, "z"), (14, "q" * 90), (15, base[5:11])]
    got = holders(spark.createDataFrame(claims, "item_id long, c string"), spark.createDataFrame(docs, "doc_id long, t string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, d) for i, c in claims for d, t in docs if c and c in t)
    assert holders(spark.createDataFrame([], "item_id long, c string"), spark.createDataFrame(docs, "doc_id long, t string")).count() == 0


def test_a_time_is_matched_once_for_all_its_groups(spark):
    from parchmint.functions import dates

    cases = {
        "at 2:35:07 p.m. or 3:10 am": ("14:35:07", "2:35:07 p.m."), "12:00 PM": ("12:00:00", "12:00 PM"), "x\n 23 : 59 hrs\ny": ("23:59:00", "23 : 59 hrs"), "13:05 pm": (None, "13:05 pm"),
        "7 h 05": ("07:05:00", "7 h 05"), "24:00": (None, "24:00"), "1:02:03.5 AM": ("01:02:03", "1:02:03.5 AM"), "1:2": None, "": None,
    }
    rows = spark.createDataFrame([(x,) for x in cases], "x string").select(dates.parse_time(F.col("x")).alias("t"))
    assert [g["t"] and (g["t"]["value"], g["t"]["raw"]) for g in rows.collect()] == list(cases.values())
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract") == 0 and plan.count("regexp_replace") == 1  # fourteen walks before


def test_words_become_lines_in_their_document(spark):
    import random

    from parchmint.sources.recorded import lines_of_words, words_to_lines

    draw = random.Random(3)
    kind = "doc_id long, pos long, text string, conf double, left int, top int, width int, height int, page int, block int, par int, line long"
    rows = [(d, p, draw.choice(["a", "b", " ", ""]), draw.choice([-1.0, 30.0, 150.0, None]), *[draw.randrange(9) for _ in range(4)], draw.choice([1, 2]), 1, draw.choice([1, None]), p // 5 % 3) for d in range(4) for p in range(draw.randrange(40))]
    words = spark.createDataFrame([*rows, (9, 0, " ", 1.0, 1, 1, 1, 1, 1, 1, 1, 1)], kind)
    want = words_to_lines(words).collect()
    docs = words.groupBy("doc_id").agg(F.collect_list(F.struct(*words.columns[1:])).alias("words"))
    got = lines_of_words(docs)
    told = lambda rows: sorted((r["doc_id"], r["first"], r["page"], r["text"], r["confidence"] and round(r["confidence"], 9), r["bbox"]) for r in rows)
    assert told(got.select("doc_id", F.explode("lines").alias("l")).select("doc_id", "l.*").collect()) == told(want)
    assert {r["doc_id"]: r["lines"] for r in got.collect()}[9] == []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Generate" not in plan  # that of collect_list above; no row for each word


def test_items_of_the_same_words_are_taken_without_comparing_the_others(spark):
    from parchmint.operators.evaluate import with_item_scores

    rows = spark.sql("SELECT array(named_struct('description', 'Red Soap bar', 'total_price', '1.00'), named_struct('description', 'soap RED', 'total_price', '2.00'), named_struct('description', 'soap red', 'total_price', '3.00'), named_struct('description', '', 'total_price', '4.00')) AS expected, array(named_struct('description', 'Red soap', 'total_price', '2.00'), named_struct('description', 'red, soap', 'total_price', '3.00'), named_struct('description', 'soap red', 'total_price', '1.00'), named_struct('description', '', 'total_price', '4.00')) AS actual")
    got = with_item_scores(rows)
    assert got.first()["scores"]["precision"] == 0.75  # the third takes what is left, two thirds alike; no words are like none
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.index("array_min(transform(_e") < plan.index("array_intersect")  # equal words are looked for first


def test_a_review_is_cut_into_sentences_once(spark):
    from parchmint.operators.reviews import generated

    none = F.lit(None).cast("string")
    rows = spark.createDataFrame([("One. Two! Three?",), ("n/a",), (None,), (" Only one",)], "t string")
    got = rows.select(generated(F.lit("Pan"), F.array(F.lit("x")), 2, none.cast("int"), none, F.col("t"), F.lit("4")).alias("g"))
    told = [(r["g"]["title"], r["g"]["body"], r["g"]["sentence_count"], r["g"]["error"]) for r in got.collect()]
    assert told == [("Review of Pan", "One. Two!", 2, None), (None, None, None, "LLM_INVALID_OUTPUT"), (None, None, None, "LLM_INVALID_OUTPUT"), ("Review of Pan", "Only one", 1, None)]
    assert got._jdf.queryExecution().analyzed().toString().count("split(") == 2  # the answer, and what is left of it


def test_most_lines_need_no_search_of_every_category(spark, monkeypatch):
    """Lines with one phrase, and amounts with thousands, are read without the longer ways, and as those read them."""
    import re

    from parchmint.functions import money
    from parchmint.operators import lexicon

    phrases = sorted({p for ps in lexicon.VOCABULARY.values() for p in ps})
    lines = [f"{a}{p}{b}" for p in phrases for a, b in (("", ""), ("X  ", " 1 234 56"), (f"X{p} ", " 7"))] + ["SOAP 1 234 56", "TIPSY", "", None]
    alone = [x for x in lines if x and len(re.findall(lexicon.PLACES.replace("(?U)", ""), x)) == 1]
    assert len(alone) > 300 and {p for p in phrases if p in alone} >= {"TOTAL", "CASH", "VAT", "S&H"}
    whole = run(spark, lexicon._several, lines)
    assert run(spark, lexicon.find_labels, lines) == [x if x is not None else [] for x in whole]
    monkeypatch.setattr(lexicon, "_several", lambda text: F.array().cast(lexicon.LABEL))
    assert run(spark, lexicon.find_labels, alone) == [whole[lines.index(x)] for x in alone]
    grouped = ["1,234.56", "1.234,56", "12,345,678.9", "12.345.678,901", "7,5", "7,50"]
    slow = run(spark, lambda c: money.canonical(c, F.lit("unknown")).try_cast(money.MONEY), grouped)
    monkeypatch.setattr(money, "canonical", lambda digits, style: F.lit(None).cast("string"))
    assert [[a["value"] for a in x] for x in run(spark, lambda c: money.amounts(c, F.lit("unknown")), grouped)] == [[v] for v in slow]


def test_what_a_rule_needs_is_never_missing(spark):
    """Text in which a rule finds something holds what tells that the rule is worth a try."""
    from pyspark.sql import functions as F

    from parchmint.functions import dates, identifiers

    rules = {n: getattr(identifiers, n) for n in identifiers.MAY}
    told = {
        "phone": ["Tel: 555 010 2000", "ph 5550102000", "mobile 555-010-2000", "Contact 5550102000", "call 555 0102000", "FAX 5550102000", "+1 555 010 2000"],
        "email": ["a@b.co"], "website": ["www.shop.com", "http://shop.com/x"],
        "tax_id": [f"{w} 123456" for w in ("VAT NO", "gst", "GSTIN", "TIN", "Tax ID", "TAX NO", "ABN", "ACN", "NIF", "CIF", "CUIT", "BIN", "EIN", "UID", "USt-IdNr", "SIRET")],
        "registration_id": [f"{w} 123456" for w in ("REG NO", "Registration ID", "Company No", "CRN", "BRN", "Trade License", "LICENSE NO")],
        "receipt_number": [f"{w} 12-A" for w in "Receipt RCPT Invoice INV BILL Order TRANS Transaction TXN TRX REF Reference TICKET CHECK DOC Document SALE REG Register BELEG KASSENBON RECHNUNG QUITTUNG FACTURE RECU FACTURA RECIBO NOTA FATTURA SCONTRINO".split()],
        "store_id": [f"{w} 12" for w in "store STR BRANCH Loc LOCATION site".split()],
        "card_type": list(identifiers.CARDS), "auth_code": ["AUTH A123", "Authorisation code 7X77", "approval 1234", "APPR 1234"],
    }
    for name, texts in told.items():
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules[name](F.col("t")).isNotNull(), F.col("t").rlike(identifiers.MAY[name])).collect()
        assert [tuple(r) for r in got] == [(t, True, True) for t in texts], name
    days = [f"{5} {m} 2026" for m in dates.MONTHS] + [f"{m.upper()} 5, 2026" for m in dates.MONTHS] + ["2026-08-25", "25 / 8 / 26", "65.12.2024"]
    times = ["2:35 pm", "2.35.10 P.M.", "14:35", "11h20", "11 H 20", "23:59:59", "2.35.10.55am"]
    for texts, parse, shape in ((days, dates.parse_date, dates.MAY_DATE), (times, dates.parse_time, dates.MAY_TIME)):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse(F.col("t")).isNotNull(), F.col("t").rlike(shape)).collect()
        assert [tuple(r) for r in got] == [(t, True, True) for t in texts]


def test_plain_items_read_as_if_searched(spark):
    from pyspark.sql import functions as F

    from parchmint.functions import money
    from parchmint.operators import items

    texts = ["Green Soap 1234.56", "Soap 0.00", "X 12.00", "Fish Box 7.50", "Kit X 123.45", "a 1.00", "Promo Rope 2.00", "Saved Rope 2.00", "Soap 1.2", "Soap  2.00", "Soap 2 3.00", "2 x 3.00 Eggs 6.00", "Ab 99999999.99"]
    rows = spark.createDataFrame([(t,) for t in texts], "normalized string").withColumn("amounts", money.amounts(F.col("normalized"), F.lit("unknown")))
    view = F.struct("normalized", F.get("amounts", F.lit(0)).alias("first"), ((F.size("amounts") == 1) & F.col("normalized").rlike(items.PLAIN_ITEM)).alias("plain"))
    got = rows.withColumn("v", F.transform(F.array(view), lambda x: F.struct(items._of_line(x, F.lit("unknown")).alias("a"), items._searched(x, F.lit("unknown")).alias("b"), x["plain"].alias("plain")))[0]).select("normalized", "v.*").collect()
    assert [r["normalized"] for r in got if r["a"] != r["b"]] == []
    assert [r["normalized"] for r in got if r["plain"]] == ["Green Soap 1234.56", "Soap 0.00", "X 12.00", "Fish Box 7.50", "Kit X 123.45", "a 1.00", "Promo Rope 2.00", "Ab 99999999.99"]
