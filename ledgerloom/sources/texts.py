"""Tables, JSON and plain files as Markdown; templates, layouts and truths kept as JSON.

Files come as path, content (text), one row each, as spark.read.text(wholetext=True) or binaryFile give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: names of languages by file suffix
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "html": "html", "css": "css", "sql": "sql", "sh": "bash", "ps1": "powershell", "yml": "yaml", "yaml": "yaml", "md": "markdown"}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def clean_markdown(c: Column) -> Column:
    """Line ends as one kind, at most one empty line in a row, no blanks at line ends."""
    s = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(s, r"(?m)[^\S\n]+$", ""), r"^\s+|\s+$", "")


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def markdown_table(rows: DataFrame, key: str, columns: list[str], order: str, most: int | None = None) -> DataFrame:
    """key and a Markdown table of its rows in order; with `most`, so many rows and a note of how many there are."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.col(c).cast("string")) for c in columns)), F.lit(" |"))
    numbered = rows.select(key, line.alias("line"), F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("k"))
    some = numbered if most is None else numbered.withColumn("line", F.when(F.col("k") <= most, F.col("line")))
    made = some.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("k", "line")))).alias("x"), F.count("*").alias("n"))
    head = f"| {' | '.join(c.replace('|', chr(92) + '|') for c in columns)} |\n| {' | '.join(['---'] * len(columns))} |\n"
    body = F.concat(F.lit(head), F.array_join(F.transform("x", lambda x: x["line"]), "\n"))
    note = F.when(F.size("x") < F.col("n"), F.format_string("\n\n*Showing %d of %d rows.*", F.size("x"), F.col("n"))).otherwise("")
    return made.select(key, F.concat(body, note).alias("markdown"))


def delimited(files: DataFrame, most: int = 60) -> DataFrame:
    """CSV and TSV files (path, content; fields without quoted line ends) -> path, markdown, n_rows, n_columns."""
    sep = F.when(suffix(F.col("path")) == "tsv", "\t").otherwise(",")
    lines = F.filter(F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n"), lambda x: F.trim(x) != "")
    df = files.select("path", sep.alias("sep"), lines.alias("lines"))
    # a separator outside quotes, then the quotes themselves
    parts = lambda x: F.transform(F.split(F.regexp_replace(x, F.concat(F.col("sep"), F.lit(r'(?=(?:[^"]*"[^"]*")*[^"]*$)')), F.lit("\x01")), "\x01"), lambda v: F.replace(F.regexp_replace(F.trim(v), r'^"|"$', ""), F.lit('""'), F.lit('"')))
    row = lambda x: F.concat(F.lit("| "), F.array_join(F.transform(parts(x), cell), " | "), F.lit(" |"))
    n = F.greatest(F.size("lines") - 1, F.lit(0))
    width = F.size(parts(F.coalesce(F.get("lines", F.lit(0)), F.lit(""))))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    shown = F.transform(F.slice("lines", 2, most), row)
    note = F.when(n > most, F.format_string("\n\n*Showing %d of %d rows.*", F.lit(most), n)).otherwise("")
    head = F.format_string("# CSV Data: %s\n\n**Dimensions:** %d rows × %d columns\n\n", file_name(F.col("path")), n, width)
    body = F.concat(row(F.coalesce(F.get("lines", F.lit(0)), F.lit(""))), F.lit("\n"), rule, F.when(F.size(shown) > 0, F.lit("\n")).otherwise(""), F.array_join(shown, "\n"), note)
    return df.select("path", F.concat(head, body).alias("markdown"), n.alias("n_rows"), width.alias("n_columns"))


def json_text(files: DataFrame, most: int = 12_000) -> DataFrame:
    """JSON files -> path, markdown: what the root is, and the text, cut behind `most` characters with a note."""
    v = F.try_parse_json("content")
    root = F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    items = F.size(F.try_variant_get(v, "$", "array<variant>"))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    about = F.when(root == "ARRAY", F.format_string("**Root Type:** Array with %d items\n", items)).when(root == "OBJECT", F.concat(F.format_string("**Root Keys (%d):** `", F.size(keys)), F.array_join(F.slice(keys, 1, 20), ", "), F.lit("`\n"))).otherwise("")
    text = F.to_json(v)
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... [Remaining JSON truncated for token economy]"))).otherwise(text)
    good = F.concat(F.format_string("# JSON Structure: %s\n\n", file_name(F.col("path"))), about, F.lit("\n```json\n"), cut, F.lit("\n```"))
    return files.select("path", F.coalesce(good, F.format_string("# Error reading JSON: %s", file_name(F.col("path")))).alias("markdown"))


def plain_text(files: DataFrame) -> DataFrame:
    """Text and code files -> path, markdown: the cleaned content, fenced under its language, and its tokens."""
    language = suffix(F.col("path"))
    for k, name in LANGUAGES.items():
        language = F.when(suffix(F.col("path")) == k, name).otherwise(language)
    language = F.when(language == "", "text").otherwise(language)
    made = F.concat(F.format_string("# File: %s\n```", file_name(F.col("path"))), language, F.lit("\n"), clean_markdown(F.coalesce("content", F.lit(""))), F.lit("\n```"))
    return files.select("path", made.alias("markdown"), token_estimate(made).alias("tokens"))


# ---- templates and layouts


def flat_templates(layouts: DataFrame) -> DataFrame:
    """supplier, mapping, successes, last_seen -> the mapping of each supplier's layout with most successes, then the last seen."""
    best = layouts.groupBy("supplier").agg(F.max(F.struct("successes", "last_seen", F.to_json("mapping").alias("m"))).alias("x"))
    return best.select("supplier", F.from_json("x.m", "map<string, string>").alias("mapping"))


def resolve_template(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """documents: doc, supplier_name, gstin -> with mapping: the template under its supplier's name, else under the gstin."""
    t = templates.groupBy("supplier").agg(F.min(F.to_json("mapping")).alias("m"))
    a, b = t.select(F.col("supplier").alias("__a"), F.col("m").alias("__m")), t.select(F.col("supplier").alias("__b"), F.col("m").alias("__n"))
    met = documents.join(a, F.col("supplier_name") == F.col("__a"), "left").join(b, F.col("gstin") == F.col("__b"), "left")
    return met.select(*documents.columns, F.from_json(F.coalesce("__m", "__n"), "map<string, string>").alias("mapping"))


def save_templates(known: DataFrame, saved: DataFrame) -> DataFrame:
    """supplier, mapping (saved: with seq): the last saved one replaces a supplier's."""
    last = saved.groupBy("supplier").agg(F.max_by(F.to_json("mapping"), "seq").alias("m")).select("supplier", F.from_json("m", "map<string, string>").alias("mapping"))
    return known.select("supplier", "mapping").join(last, "supplier", "left_anti").unionByName(last)


def truth_of(documents: DataFrame, truths: DataFrame) -> DataFrame:
    """documents: doc, filename, sha256 -> the truth (truth_id) of the same id, else the same file name, else the same hash."""
    out = documents
    for k, (c, own) in enumerate((("document_id", "doc"), ("filename", "filename"), ("sha256", "sha256"))):
        one = truths.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"__c{k}")).agg(F.min("truth_id").alias(f"__t{k}"))
        out = out.join(one, F.col(own).cast("string") == F.col(f"__c{k}"), "left")
    return out.select(*documents.columns, F.coalesce("__t0", "__t1", "__t2").alias("truth_id"))


# ---- exports


PROVENANCE = ["batch_id", "document_id", "filename", "file_hash", "supplier_name", "supplier_gstin", "decision", "confidence"]


def batch_rows(documents: DataFrame, rows: DataFrame, batch_id: str, include_failed: bool = False) -> DataFrame:
    """Rows (document_id and product columns) behind the columns of PROVENANCE, to be written as any format."""
    docs = documents.withColumn("batch_id", F.lit(batch_id)).select(*PROVENANCE, "status")
    if not include_failed:
        docs = docs.where("status <> 'FAILED'")
    own = [c for c in rows.columns if c not in PROVENANCE]
    return docs.join(rows.select("document_id", *own), "document_id").select(*PROVENANCE, *own)


def report(metrics: DataFrame, title: str) -> DataFrame:
    """section, line_no, label, value -> one row with a Markdown report; sections by name, lines by number."""
    lines = metrics.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("line_no", F.format_string("- **%s**: `%s`", "label", F.col("value").cast("string")).alias("t")))).alias("x"))
    parts = lines.select(F.struct("section", F.concat(F.format_string("## %s\n\n", "section"), F.array_join(F.transform("x", lambda x: x["t"]), "\n")).alias("t")).alias("p"))
    # a few sections
    return parts.agg(F.array_sort(F.collect_list("p")).alias("p")).select(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("p", lambda p: p["t"]), "\n\n"), F.lit("\n")).alias("markdown"))
