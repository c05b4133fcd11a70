"""Text sources: event-stream frames, provider chunks, unified diffs, chat bodies, file trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_BODY_BYTES = 262_144
MOST_FILE_BYTES = 1 << 20
#: folders and endings that hold no source text
SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv", "dist", "build")
BINARY_ENDINGS = ("png", "jpg", "jpeg", "gif", "pdf", "zip", "gz", "jar", "class", "so", "exe", "pyc", "woff", "ico")


def sse_frames(lines: DataFrame) -> DataFrame:
    """(request_id, frame, event, data) of lines (request_id, seq, line): a blank line ends a frame, data lines are joined."""
    order = Window.partitionBy("request_id").orderBy("seq")
    blank = F.trim("line") == ""
    framed = lines.withColumn("frame", F.count(F.when(blank, 1)).over(order.rowsBetween(Window.unboundedPreceding, -1))).where(~blank)
    field, value = F.substring_index("line", ":", 1), F.regexp_replace(F.substr("line", F.locate(":", F.col("line")) + 1), "^ ", "")
    parts = framed.select("request_id", "frame", "seq", field.alias("field"), value.alias("value"))
    data = F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == "data", F.struct("seq", "value")))), lambda x: x["value"])
    return parts.groupBy("request_id", "frame").agg(F.coalesce(F.max_by(F.when(F.col("field") == "event", F.col("value")), F.when(F.col("field") == "event", F.col("seq"))), F.lit("message")).alias("event"), F.array_join(data, "\n").alias("data"))


def chunk_text(lines: DataFrame) -> DataFrame:
    """The text of each request's provider stream: data lines of JSON, the end mark and malformed frames passed over."""
    body = F.regexp_extract("line", r"^data: ?(.*)$", 1)
    parsed = F.from_json(body, "delta string, finish string")
    rows = lines.where((body != "") & (body != "[DONE]")).select("request_id", "seq", parsed["delta"].alias("delta")).where("delta is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"])
    return rows.groupBy("request_id").agg(F.array_join(ordered, "").alias("text"), F.count("*").alias("n_chunks"))


def added_lines(diff: DataFrame) -> DataFrame:
    """(path, line) of every line a unified diff (diff_id, seq, line) adds."""
    order = Window.partitionBy("diff_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    path = F.when(F.startswith("line", F.lit("+++ ")), F.regexp_replace("line", r"^\+\+\+ (?:b/)?", ""))
    start = F.when(F.startswith("line", F.lit("@@")), F.regexp_extract("line", r"\+([0-9]+)", 1).cast("int"))
    head = F.startswith("line", F.lit("@@")) | F.startswith("line", F.lit("+++ ")) | F.startswith("line", F.lit("--- "))
    stays = F.when(~head & ~F.startswith("line", F.lit("-")), 1).otherwise(0)
    # what is sorted holds no text but the paths; all windows share one order, so each task sorts once
    slim = diff.select("diff_id", "seq", path.alias("path"), start.alias("start"), stays.alias("stays"), (~head & F.startswith("line", F.lit("+"))).alias("added"))
    counted = slim.withColumn("n", F.sum("stays").over(order))
    from_here = F.when(F.col("start").isNotNull() | F.col("path").isNotNull(), F.col("n"))
    marked = counted.select("stays", "added", "n", F.last("path", True).over(order).alias("path"), F.last("start", True).over(order).alias("start"), F.last(from_here, True).over(order).alias("before"))
    return marked.where("added and start is not null").select("path", (F.col("start") + F.col("n") - F.col("stays") - F.col("before")).cast("int").alias("line"))


def chat_bodies(bodies: DataFrame, body: str) -> DataFrame:
    """Parsed chat bodies no larger than the limit; malformed ones are marked, not dropped."""
    parsed = F.from_json(body, "model string, messages array<struct<role:string,content:string>>, stream boolean")
    size = F.octet_length(body)
    status = F.when(size > MOST_BODY_BYTES, "too_large").when(parsed["messages"].isNull() | (F.size(parsed["messages"]) < 1), "invalid").otherwise("ok")
    return bodies.select("*", status.alias("status"), F.when(status == "ok", F.size(parsed["messages"])).alias("n_messages"), F.when(status == "ok", parsed["model"]).alias("model"))


def reference_docs(header: Column) -> Column:
    """A JSON array of strings, or null for anything else."""
    return F.from_json(header, "array<string>")


def ndjson_text(lines: DataFrame) -> DataFrame:
    """The text of each request's stream of JSON lines (request_id, seq, line): malformed and blank lines are passed over, what follows the end is not read.

    (request_id, model, text, n_chunks, finish_reason); a reason that is not stated at the end counts as stop.
    """
    parsed = F.from_json("line", "model string, message struct<content:string>, done boolean, done_reason string", {"mode": "PERMISSIVE"})
    rows = lines.where(F.trim("line") != "").select("request_id", "seq", parsed.alias("p")).where("p.model is not null or p.message is not null or p.done is not null")
    ended = F.min(F.when(F.coalesce(F.col("p.done"), F.lit(False)), F.col("seq"))).over(Window.partitionBy("request_id"))
    read = rows.withColumn("last", ended).where(F.col("last").isNull() | (F.col("seq") <= F.col("last")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("p.message.content", F.lit("")).alias("delta")))), lambda x: x["delta"])
    reason = F.max(F.when(F.col("seq") == F.col("last"), F.coalesce("p.done_reason", F.lit("stop"))))
    return read.groupBy("request_id").agg(F.max("p.model").alias("model"), F.array_join(ordered, "").alias("text"), F.count("*").alias("n_chunks"), reason.alias("finish_reason"))


def as_pattern(glob: str) -> str:
    """A file glob (* any run of signs, ? any one, [...] one of these) as a regular expression over the whole path."""
    out, i = "", 0
    while i < len(glob):
        sign = glob[i]
        close = glob.find("]", i + 2) if sign == "[" else -1
        if close > 0:
            inner = glob[i + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = close
        else:
            out += {"*": ".*", "?": "."}.get(sign, "\\" + sign if not sign.isalnum() and sign not in "_/" else sign)
        i += 1
    return f"^(?s:{out})$"


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether lines of a .gitignore file rule a path out: the last line that matches decides, ! takes it back in.

    A line with a slash at its beginning or inside holds from the root, any
    other at every depth; one that ends in a slash holds for folders only.
    """
    out = F.lit(False)
    for line in rules:
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.lstrip("!")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        rooted, rule = "/" in rule, rule.lstrip("/")
        body = as_pattern(rule.replace("**/", "\0").replace("/**", "\1"))[5:-2].replace(".*", "[^/]*").replace("\\\0", "(?:.*/)?").replace("\\\1", "/.*")
        pattern = ("^" if rooted else "(?:^|.*/)") + f"(?:{body})" + ("/.*$" if folder else "(?:/.*)?$")
        out = F.when(path.rlike(pattern), F.lit(not back)).otherwise(out)
    return out


def scannable(tree: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, gitignore: list[str] | None = None, max_bytes: int = MOST_FILE_BYTES) -> DataFrame:
    """(path, text) of a tree's files (path, length, content) that are worth reading.

    Left out: skipped folders, binary endings, files over the limit or with a
    NUL at the beginning, what the ignore rules or the exclude globs name, and,
    if there are include globs, what none of these names.
    """
    skipped = F.exists(F.split("path", "/"), lambda d: d.isin(*SKIPPED_FOLDERS))
    ending = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    wanted = ~skipped & ~ending.isin(*BINARY_ENDINGS) & (F.col("length") <= max_bytes) & ~ignored(F.col("path"), gitignore or [])
    for globs, good in ((include, True), (exclude, False)):
        if globs:
            hit = F.col("path").rlike("|".join(map(as_pattern, globs)))
            wanted = wanted & (hit if good else ~hit)
    probe = F.hex(F.substring(F.col("content"), 1, 8000))
    return tree.where(wanted).where(~probe.rlike("^(?:..)*?00")).select("path", F.decode("content", "UTF-8").alias("text"))


def files(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None, gitignore: list[str] | None = None) -> DataFrame:
    """(path, text) of a folder's source files, paths as in the folder; see ``scannable``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.lit(path.rstrip("/").split("://", 1)[-1] + "/")
    place = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    return scannable(raw.select(F.regexp_replace(F.when(F.startswith(place, root), F.substr(place, F.length(root) + 1)).otherwise(place), "^/+", "").alias("path"), "length", "content"), include, exclude, gitignore)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint) of a baseline, one file or a folder of them, however its JSON is laid out."""
    raw = spark.read.text(path, wholetext=True)
    found = F.regexp_extract_all("value", F.lit(r'"fingerprint"\s*:\s*"([^"]*)"'), F.lit(1))
    return raw.select(F.explode(found).alias("fingerprint")).distinct()


def write_baseline(findings: DataFrame, path: str) -> None:
    """Fingerprints with their places, never values; one object a part, as ``read_baseline`` reads them."""
    rows = findings.select(F.struct("fingerprint", "path", F.col("line").cast("int").alias("line"), "type").alias("f"))
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.sort_array(F.collect_list("f")).alias("findings"))
    parts.select(F.to_json(F.struct(F.lit(1).alias("version"), "findings")).alias("value")).write.mode("overwrite").text(path)
