"""Recorded recognition results and the ways a document finds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.config import Settings
from parchmint.functions.spans import let
from parchmint.operators.gates import FALLBACK

BOX = "array<int>"
RECORDED = f"text string, lines array<struct<text:string,confidence:double,bbox:{BOX},page:int,words:array<struct<text:string,confidence:double,bbox:{BOX}>>>>, languages array<string>, width int, height int, model string, source string"
LINES = f"array<struct<text:string,confidence:double,bbox:{BOX}>>"
#: Fixed value: the end of a recorded result's file name.
SUFFIX = ".ocr.json"
_PROVIDERS: dict[str, Callable[..., DataFrame]] = {}


def recorded_json(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name without .ocr.json), lines and raw columns of recorded results."""
    rows = spark.read.schema(RECORDED).option("multiLine", True).json(path).withColumn("doc_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.ocr\.json$", ""))
    return rows.withColumn("lines", effective_lines())


def available(spark: SparkSession, root: str) -> DataFrame:
    """(name, path) of recorded results in root and one level below, told from the listing: no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", True).load(root).select("path")
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    depth = whole.count("/") + 1
    below = F.size(F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), "/")) - 1
    return files.where(below <= depth + 1).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), SUFFIX.replace(".", r"\.") + "$", "").alias("name"), "path")


def recorded_for(spark: SparkSession, requests: DataFrame, root: str, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, key, lines, error) of requests (doc_id, name, content): the result recorded under the request's name, its content's SHA-256, or `default`.

    A name counts by its last part, so none leaves root. Without a result the error is OCR_EMPTY_RESULT, with one
    that cannot be read OCR_FAILED; in production every request has PROVIDER_UNAVAILABLE.
    """
    asked = requests.withColumn("name", F.element_at(F.split(F.col("name"), "/"), -1))
    if settings.production:
        return asked.select("doc_id", F.lit(None).cast("string").alias("key"), F.lit(None).cast(LINES).alias("lines"), F.lit("PROVIDER_UNAVAILABLE").alias("error"))
    names = available(spark, root)
    keys = asked.select("doc_id", F.posexplode(F.array("name", F.sha2("content", 256), F.lit("default"))).alias("rank", "name"))
    hits = keys.join(names, "name").groupBy("doc_id").agg(F.min_by(F.struct(F.col("name").alias("key"), "path"), F.struct("rank", "path")).alias("hit"))
    payload = spark.read.schema(RECORDED + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", True).json(root)
    read = payload.select(F.col("_metadata.file_path").alias("path"), effective_lines().alias("lines"), F.col("_corrupt").isNotNull().alias("bad"))
    same = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    found = hits.select("doc_id", "hit.key", same("hit.path").alias("path")).join(read.withColumn("path", same("path")), "path", "left")
    error = F.when(F.col("key").isNull(), "OCR_EMPTY_RESULT").when(F.coalesce("bad", F.lit(True)), "OCR_FAILED")
    return requests.select("doc_id").join(found, "doc_id", "left").select("doc_id", "key", F.when(~F.col("bad"), F.col("lines")).alias("lines"), error.alias("error"))


def effective_lines() -> Column:
    """Lines with a score: their own, else the mean of their words', else null."""
    mean = lambda ws: F.try_divide(F.aggregate(ws, F.lit(0.0), lambda a, w: a + F.coalesce(w["confidence"], F.lit(0.0))), F.size(F.filter(ws, lambda w: w["confidence"].isNotNull())))
    return F.transform(F.coalesce("lines", F.array().cast(f"array<struct<text:string,confidence:double,bbox:{BOX},page:int,words:array<struct<text:string,confidence:double,bbox:{BOX}>>>>")), lambda x: F.struct(x["text"].alias("text"), F.coalesce(x["confidence"], mean(x["words"])).alias("confidence"), x["bbox"].alias("bbox")))


def resolve(requests: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each request (doc_id, name, content) with the payload of its name, its content's SHA-256, or `default`."""
    p = payloads.select(F.col("doc_id").alias("_key"), F.col("lines"))
    keys = requests.withColumn("_keys", F.array(F.col("name"), F.sha2("content", 256), F.lit("default")))
    each = keys.select("*", F.posexplode("_keys").alias("_rank", "_key")).join(p, "_key", "left").where(F.col("lines").isNotNull())
    best = each.groupBy("doc_id").agg(F.min_by(F.struct(F.col("_key").alias("key"), "lines"), "_rank").alias("hit"))
    return requests.select("doc_id").join(best, "doc_id", "left").select("doc_id", "hit.key", "hit.lines")


def words_to_lines(words: DataFrame) -> DataFrame:
    """(doc_id, line, text, confidence, bbox) of engine words (doc_id, pos, text, conf, left, top, width, height, page, block, par, line).

    Blank words go; a score of -1 is none; lines come in the order in which their first word does.
    """
    own = words.where(F.length(F.trim("text")) > 0)
    score = F.avg(F.when(F.col("conf") >= 0, F.least(F.col("conf") / 100, F.lit(1.0))))
    lines = own.groupBy("doc_id", "page", "block", "par", "line").agg(
        F.min("pos").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"),
        score.alias("confidence"),
        F.array(F.min("left"), F.min("top"), F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height"))).alias("bbox"),
    )
    return lines.select("doc_id", "first", (F.col("page") - 1).alias("page"), "text", "confidence", "bbox")


def lines_of_words(docs: DataFrame, boxes: bool = True) -> DataFrame:
    """(doc_id, lines) of docs (doc_id, words array<struct<pos, text, conf, left, ... line>>): what words_to_lines tells of them, in the document's row.

    lines is array<struct<first, page, text, confidence, bbox>>, without boxes bbox is null and words need no places. Words are sorted and cut where their line changes:
    none moves, and each is looked at a fixed number of times.
    """
    score = lambda x: F.when(x["conf"] >= 0, F.least(x["conf"] / 100, F.lit(1.0)))
    own = F.filter("words", lambda x: F.length(F.trim(x["text"])) > 0)
    placed = lambda x: [x["left"].alias("left"), x["top"].alias("top"), (x["left"] + x["width"]).alias("right"), (x["top"] + x["height"]).alias("low")]
    told = lambda x: F.struct(F.struct(*[x[c] for c in ("page", "block", "par", "line")]).alias("key"), x["pos"].alias("pos"), x["text"].alias("text"), score(x).alias("score"), *(placed(x) if boxes else []))
    rows = docs.select("doc_id", F.sort_array(F.transform(own, told)).alias("_words"))
    n = F.size("_words")
    begins = lambda i: (i == 0) | ~F.get("_words", i)["key"].eqNullSafe(F.get("_words", i - 1)["key"])
    rows = rows.withColumn("_starts", F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), begins)).otherwise(F.array().cast("array<int>")))
    each = lambda ws, c: F.transform(ws, lambda x: x[c])

    def line(ws: Column) -> Column:
        scores = F.array_compact(each(ws, "score"))
        box = F.array(F.array_min(each(ws, "left")), F.array_min(each(ws, "top")), F.array_max(each(ws, "right")), F.array_max(each(ws, "low"))) if boxes else F.lit(None).cast(BOX)
        return F.struct(F.array_min(each(ws, "pos")).alias("first"), (F.get(ws, F.lit(0))["key"]["page"] - 1).alias("page"), F.array_join(each(ws, "text"), " ").alias("text"), F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, s: a + s), F.size(scores)).alias("confidence"), box.alias("bbox"))

    cut = F.transform("_starts", lambda s, j: let(F.slice("_words", s + 1, F.coalesce(F.get("_starts", j + 1), n) - s), line))
    return rows.select("doc_id", F.sort_array(cut).alias("lines"))


def upload_error(length: Column, max_bytes: int = 10 * 1024 * 1024) -> Column:
    """Why an upload of that length is not taken, else null."""
    return F.when(length > max_bytes, "IMAGE_TOO_LARGE").when(length == 0, "EMPTY_FILE")


def uploads(spark: SparkSession, path: str, max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Files as path, length, content and error; larger ones are told of but not read.

    Spark's scan passes over files without a byte, so those have no row here; upload_error knows them
    where uploads come as a table.
    """
    files = spark.read.format("binaryFile").load(path)
    fit = files.where(F.col("length") <= max_bytes).select("path", "length", "content")
    large = files.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return fit.unionByName(large).withColumn("error", upload_error(F.col("length"), max_bytes))


def register(name: str, provider: Callable[..., DataFrame]) -> None:
    """Make a provider of lines known by its lower-cased name."""
    _PROVIDERS[name.lower()] = provider


def provider(name: str) -> Callable[..., DataFrame]:
    """The provider of a name; "a+b" takes a's rows and b's for documents that a has no row for, or a row with an error of its own.

    A row of b tells that it served, and the error of a (first_error) if a gave one; an error that says something
    of the document stays as it is. A provider of calls is sources.calls.recognised.
    """
    first, plus, second = name.lower().partition("+")
    for part in (first, second) if plus else (first,):
        if part not in _PROVIDERS:
            raise KeyError(f"PROVIDER_NOT_REGISTERED: {part}; known: {', '.join(sorted(_PROVIDERS))}")
    if not plus:
        return _PROVIDERS[first]

    def chain(docs: DataFrame) -> DataFrame:
        given = _PROVIDERS[first](docs)
        error = F.col("error") if "error" in given.columns else F.lit(None).cast("string")
        asked = F.coalesce(error.isin(*FALLBACK), F.lit(False))
        got = given.where(~asked).withColumns({"served_by_fallback": F.lit(False), "first_error": F.lit(None).cast("string")})
        failed = given.where(asked).select("doc_id", error.alias("first_error"))
        rest = docs.join(got.select("doc_id"), "doc_id", "left_anti")
        told = _PROVIDERS[second](rest).withColumn("served_by_fallback", F.lit(True)).join(failed, "doc_id", "left")
        return got.unionByName(told, allowMissingColumns=True)

    return chain


register("recorded", lambda docs: docs.select("doc_id", "lines"))
