"""Log sources as DataFrames of columns: native expressions over a column `line`.

Parsers keep every row and add `parse_ok`; a malformed line is rejected, never an error."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logshield.functions.classify import held, resolved_ip, seam
from logshield.functions.ip import ip_v4, is_ip

COMBINED = '$remote_addr - $remote_user [$time_local] "$request" $status $body_bytes_sent "$http_referer" "$http_user_agent"'
EDGE = COMBINED + ' "$http_cf_connecting_ip"'
#: Log variables and the columns they fill; others are read over.
VARIABLES = {
    "remote_addr": "remote", "http_cf_connecting_ip": "edge", "http_x_forwarded_for": "forwarded", "request": "request", "request_method": "method",
    "request_uri": "uri", "uri": "uri", "status": "status", "http_referer": "referer", "http_user_agent": "user_agent", "host": "host", "http_host": "host",
}


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, src_file, line_key): lines that are valid UTF-8, in an order that holds per file."""
    rows = spark.read.text(path).withColumnRenamed("value", "line").where("is_valid_utf8(line)")
    key = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return rows.select("line", F.col("_metadata.file_path").alias("src_file"), key.alias("line_key"))


def _words(request: Column) -> Column:
    return F.split(F.trim(request), "\\s+")


def _request(df: DataFrame, request: Column | None, method: Column | None = None, uri: Column | None = None, words: Column | None = None) -> DataFrame:
    """Method and path of a request line, or of its words, explicit fields first, GET and / at last."""
    part = _words(request) if words is None else words
    filled = lambda c: F.when(c != "", c)
    first = [F.lit(None).cast("string") if c is None else filled(c) for c in (method, uri)]
    return df.withColumn("method", F.coalesce(first[0], filled(F.get(part, F.lit(0))), F.lit("GET"))).withColumn("uri", F.coalesce(first[1], filled(F.get(part, F.lit(1))), F.lit("/")))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\r\x0b\x0c"))


def _u16(text: Column) -> Column:
    n = text.try_cast("int")
    return F.when(text.rlike("^\\+?[0-9]+$") & n.between(0, 65535), n)


def parse_combined(df: DataFrame) -> DataFrame:
    """client_ip, method, uri, status, referer, user_agent of combined lines. A line is split at its
    first six quotes, so that it is read once whether it is taken or not; U+0001, which no server writes,
    reads as a blank. The address ends at a blank, the status at white space. A seam keeps what makes
    the lines out of the generated method, which is too long to be compiled otherwise."""
    line = F.replace(_trimmed(F.col("line")), F.lit("\x01"), F.lit(" "))
    got = seam(df).withColumn("_p", held(F.split(line, '"', 7)))
    part = lambda i: F.get("_p", F.lit(i))
    ip, status = F.when(part(0).contains(" "), F.substring_index(part(0), " ", 1)), F.regexp_extract(part(2), r"^\s*+(\+?[0-9]++)\s", 1)
    got = got.withColumns({"_ip": held(ip), "status": held(status.try_cast("int")), "_words": held(_words(part(1)))})
    got = got.withColumn("status", held(F.when(F.col("status").between(0, 65535), F.col("status"))))
    got = got.withColumn("parse_ok", held(F.coalesce((F.size("_p") == 7) & F.col("status").isNotNull() & is_ip(F.col("_ip")), F.lit(False))))
    got = _request(got, None, words=F.col("_words")).withColumn("client_ip", F.when(F.col("parse_ok"), F.col("_ip"))).withColumn("referer", part(3)).withColumn("user_agent", part(5))
    return got.drop("_p", "_ip", "_words")


def format_pattern(log_format: str) -> tuple[str, list[str]]:
    """A regex of a log format and its variables. Each literal is pinned to its first occurrence
    by an atomic group, so a line is read once whether it matches or not."""
    if len(log_format) > 1 and log_format[0] == log_format[-1] and log_format[0] in "'\"":
        log_format = log_format[1:-1]
    parts = re.split(r"(\$\$|\$\{\w+\}|\$\w+)", log_format)
    names, out, pending = [], "(?s)^", False
    tokens = [p for p in parts if p]
    for i, p in enumerate(tokens):
        if p.startswith("$") and p != "$$":
            if pending:
                out += "(?>([^ ]*) ?)"
            names.append(p.strip("${}"))
            pending = True
        else:
            literal = re.escape("$" if p == "$$" else p)
            out += f"(?>(.*?){literal})" if pending else literal
            pending = False
    return out + ("(.*)$" if pending else ""), names


def _named(df: DataFrame, get, line_ok: Column) -> DataFrame:
    """The columns of a delimited line from its variables, `get(column)` being their text or ''."""
    ip = resolved_ip(get("edge"), get("forwarded"), get("remote"))
    got = _request(df.withColumn("_ip", ip), get("request"), get("method"), get("uri"))
    got = got.withColumn("status", F.coalesce(_u16(get("status")), F.lit(200))).withColumn("referer", get("referer")).withColumn("user_agent", get("user_agent")).withColumn("host", get("host"))
    ok = F.coalesce(line_ok & F.col("_ip").isNotNull(), F.lit(False))
    return got.withColumn("client_ip", F.when(ok, F.col("_ip"))).withColumn("parse_ok", ok).drop("_ip")


def parse_format(df: DataFrame, log_format: str = COMBINED) -> DataFrame:
    """The columns of parse_combined plus host, by a `$variable` format."""
    pattern, names = format_pattern(log_format)
    line = _trimmed(F.col("line"))
    cols = {}
    for i, name in enumerate(names):
        if name in VARIABLES:
            cols.setdefault(VARIABLES[name], F.regexp_extract(line, pattern, i + 1))
    return _named(df, lambda c: cols.get(c, F.lit("")), line.rlike(pattern))


def _compiled(batches):
    """(path, format) to (path, pattern, places): a format's regex and the group of each column."""
    for batch in batches:
        made = [format_pattern(f or COMBINED) for f in batch.column(1).to_pylist()]
        places = []
        for _, names in made:
            at: dict[str, int] = {}
            for i, name in enumerate(names):
                if name in VARIABLES:
                    at.setdefault(VARIABLES[name], i + 1)
            places.append(list(at.items()))
        cols = [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array(places, pa.map_(pa.string(), pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, ["path", "pattern", "places"])


def parse_by_file(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """The columns of parse_format for lines(src_file, line, ...), batch or stream, each by the format of
    its file in catalog(path, format), see resolve_log_catalog; files that are not in it are combined.
    Formats are compiled where the catalog is and joined as data, so that any number of them is read
    in one pass; lines of formats that are JSON objects go to parse_json."""
    formats = catalog.select("path", "format").groupBy("path").agg(F.min("format").alias("format"))
    known = formats.mapInArrow(_compiled, "path string, pattern string, places map<string,int>").join(formats.select("path", (format_kind(F.col("format")) == "json").alias("json")), "path")
    pattern, names = format_pattern(COMBINED)
    rows = df.join(known, df["src_file"] == known["path"], "left").drop("path")
    places = F.create_map(*(F.lit(x) for i, n in enumerate(names) if n in VARIABLES for x in (VARIABLES[n], i + 1)))
    rows = rows.withColumns({"_pattern": F.coalesce("pattern", F.lit(pattern)), "_places": F.coalesce("places", places), "_json": F.coalesce("json", F.lit(False))}).drop("pattern", "places", "json")
    line = _trimmed(F.col("line"))

    def get(column: str) -> Column:
        at = F.try_element_at("_places", F.lit(column))
        return F.when(at.isNotNull(), F.call_function("regexp_extract", line, F.col("_pattern"), at)).otherwise("")

    cols = ("client_ip", "method", "uri", "status", "referer", "user_agent", "host", "parse_ok")
    plain = _named(rows, get, F.call_function("rlike", line, F.col("_pattern"))).select(*rows.columns, held(F.when(~F.col("_json"), F.struct(*cols))).alias("_a"))
    told = parse_json(plain.withColumnRenamed("line", "_line").withColumn("line", held(F.when(F.col("_json"), F.col("_line"))))).withColumn("line", F.col("_line"))
    taken = lambda c: F.when(F.col("_json"), F.col(c)).otherwise(F.col("_a")[c])
    return told.select(*df.columns, *(taken(c).alias(c) for c in cols))


_IP = ("client", "client_ip", "remote_addr", "ip")
_TEXTS = (*_IP, "http_cf_connecting_ip", "http_x_forwarded_for", "method", "request_method", "uri", "path", "request_uri", "request", "referer", "http_referer", "ua", "user_agent", "http_user_agent", "host", "http_host")


def parse_json(df: DataFrame, replay: bool = False) -> DataFrame:
    """The columns of parse_format from JSON lines with the usual key aliases.

    A line must be one JSON object and no more. Known keys must be texts written without escapes (or
    null) and be there once, but for status, which may be a number or a text. In replay form the
    forwarding headers are last resorts, `request` is a whole uri, and of several aliases the first one
    present counts, whatever its value: a text, or else nothing. Repeated keys are refused in both forms."""
    line = _trimmed(F.col("line"))
    # In brackets, so that what follows the object is no JSON, or a second element.
    got = df.withColumn("_v", held(F.when(line.startswith("{"), F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))))))
    one = F.col("_v").isNotNull() & F.try_variant_get("_v", "$[1]", "variant").isNull()
    kind = lambda k: F.schema_of_variant(F.try_variant_get("_v", f"$[0].{k}", "variant"))
    value = lambda k: F.try_variant_get("_v", f"$[0].{k}", "string")
    # Only values of keys that are there are looked up. Seams keep the generated methods small.
    got = seam(seam(got).withColumn("_t", held(F.when(one, F.struct(*(kind(k).alias(k) for k in (*_TEXTS, "status")))))))
    got = seam(got.withColumn("_s", held(F.when(F.col("_t").isNotNull(), F.struct(*(F.when(F.col(f"_t.{k}").isNotNull(), value(k)).alias(k) for k in (*_TEXTS, "status")))))))
    text = lambda k: F.when(F.col(f"_t.{k}") == "STRING", F.col(f"_s.{k}"))
    blank, status = F.lit(""), F.col("_s.status")
    if replay:

        def f(*keys: str) -> Column:
            out = F.lit(None).cast("string")
            for k in reversed(keys):
                out = F.when(F.col(f"_t.{k}").isNotNull(), text(k)).otherwise(out)
            return out

        ok = one
        ip = F.trim(F.substring_index(f(*_IP, "http_cf_connecting_ip", "http_x_forwarded_for"), ",", 1))
        got = got.withColumn("method", F.coalesce(f("method", "request_method"), F.lit("GET"))).withColumn("uri", F.coalesce(f("uri", "path", "request_uri", "request"), F.lit("/")))
    else:
        f = lambda *keys: F.coalesce(*(text(k) for k in keys))
        # A text that holds no escape is in the line as it is.
        bare = lambda k: line.contains("\\").isNull() | ~line.contains("\\") | F.call_function("contains", line, F.concat(F.lit('"'), text(k), F.lit('"')))
        ok = one & _all((F.coalesce(F.col(f"_t.{k}").isin("VOID"), F.lit(True)) | ((F.col(f"_t.{k}") == "STRING") & bare(k))) for k in _TEXTS)
        ip = resolved_ip(f("http_cf_connecting_ip"), f("http_x_forwarded_for"), f(*_IP))
        got = _request(got, f("request"), f("method", "request_method"), f("uri", "path", "request_uri"))
    # Numbers are cut to 16 bits; texts must fit them.
    number = F.when(F.col("_t.status") == "BIGINT", F.when(status.try_cast("long") >= 0, status.try_cast("long") % 65536)).when(F.col("_t.status") == "STRING", _u16(status))
    got = got.withColumn("status", F.coalesce(number, F.lit(200)).cast("int")).withColumn("referer", F.coalesce(f("referer", "http_referer"), blank))
    got = got.withColumn("user_agent", F.coalesce(f("ua", "user_agent", "http_user_agent"), blank)).withColumn("host", F.coalesce(f("host", "http_host"), blank))
    got = got.withColumn("_ip", held(ip)).withColumn("parse_ok", held(F.coalesce(ok, F.lit(False)) & is_ip(F.col("_ip"))))
    return got.withColumn("client_ip", F.when(F.col("parse_ok"), F.col("_ip"))).drop("_v", "_t", "_s", "_ip")


def parse_error_log(df: DataFrame) -> DataFrame:
    """(client_ip, reason) of error lines: what stands before the client, from the text behind `[error]`
    and its colon on, or from the line's start for other levels; a connection marker, and what is
    before it, is left out."""
    line = F.col("line")
    tail = lambda text, at: F.substring(text, at, F.char_length(line) + 1)
    client, level = F.instr(line, ", client: "), F.instr(line, "[error]")
    after = tail(line, client + 10)
    end = F.coalesce(F.nullif(F.instr(after, ","), F.lit(0)), F.nullif(F.instr(after, " "), F.lit(0)), F.char_length(after) + 1)
    ip = F.when(client > 0, F.trim(F.substring(after, F.lit(1), end - 1)))
    colon = F.instr(tail(line, level + 7), ": ")
    start = F.when(level == 0, 1).otherwise(level + 7 + F.when(colon > 0, colon + 1).otherwise(0))
    said = F.when(start < client, F.substring(line, start, client - start)).otherwise(F.substring(line, F.lit(1), client - 1))
    star = F.instr(said, "*")
    blank = F.instr(tail(said, star), " ")
    said = F.when((star > 0) & (blank > 0), tail(said, star + blank)).otherwise(said)
    return df.withColumn("client_ip", F.when(is_ip(ip), ip)).withColumn("reason", F.when(is_ip(ip), F.trim(said)))


def _after(line: Column, *marks: str) -> Column:
    """What follows one of the marks, cut at white space or a colon."""
    return F.regexp_extract(line, "(?:" + "|".join(map(re.escape, marks)) + r")([^\s:]+)", 1)


def _address(text: Column) -> Column:
    return F.when(is_ip(text), text)


def parse_auth_log(df: DataFrame) -> DataFrame:
    """kind (auth_failure, scanner_probe, ignore), client_ip, user and reason of ssh lines; a branch
    whose address does not parse falls through to the next. A text is taken from a line once, and only
    where the line has what it follows."""
    line = F.col("line")
    failed = r"Failed password for (?:invalid user )?(\S+) from (\S+)"
    unknown = r"Invalid user (\S+) from (\S+)"
    texts = {
        "_banner": (_after(line, "banner exchange: Connection from "), "banner exchange: "), "_kex": (_after(line, "Connection from ", "from ", "by "), "kex_exchange_identification"),
        "_silent": (_after(line, "Did not receive identification string from "), "Did not receive identification"),
        "_failed": (F.regexp_extract(line, failed, 2), "Failed password for "), "_unknown": (F.regexp_extract(line, unknown, 2), "Invalid user "),
    }
    got = df.withColumns({k: held(F.when(line.contains(mark), text)) for k, (text, mark) in texts.items()})
    got = got.withColumns({k: held(_address(F.col(k))) for k in texts})
    probe = F.when(F.col("_banner").isNotNull(), "banner_invalid_format").when(F.col("_kex").isNotNull(), "invalid_protocol_identifier").when(F.col("_silent").isNotNull(), "no_identification_string")
    user = F.when(F.col("_failed").isNotNull(), F.regexp_extract(line, failed, 1)).when(F.col("_unknown").isNotNull(), F.regexp_extract(line, unknown, 1))
    return (
        got.withColumn("reason", held(probe)).withColumn("client_ip", F.coalesce(*texts))
        .withColumn("user", F.when(F.col("reason").isNull(), user))
        .withColumn("kind", F.when(F.col("reason").isNotNull(), "scanner_probe").when(F.col("client_ip").isNotNull(), "auth_failure").otherwise("ignore")).drop(*texts)
    )


def with_marks(df: DataFrame) -> DataFrame:
    """Parsed ssh lines with the process (pid), the marker of a marker line (_mark) and the
    address that would take a pending marker (_ip)."""
    line = F.col("line")
    marker = F.when(line.contains("client sent invalid protocol identifier"), "invalid_protocol_identifier").when(line.contains("banner line contains invalid characters"), "banner_invalid_format")
    rows = df.withColumns({"pid": held(F.regexp_extract("line", r"sshd\[([0-9]+)\]", 1)), "_mark": held(marker), "_ip": held(_after(line, "Connection from ", "from "))})
    return rows.withColumns({"pid": F.nullif("pid", F.lit("")).cast("long"), "_ip": held(_address(F.col("_ip")))})


def parse_auth_log_stateful(df: DataFrame, order: tuple[str, ...] = ("ts_sec", "row_id"), key: tuple[str, ...] | None = None) -> DataFrame:
    """As parse_auth_log, but a marker line of an sshd process makes its next line with an address
    a scanner probe. The last marker or consuming line before a row tells what is pending. Processes
    are told apart by `key`, src_file if there is one, and pid; lines without a pid have nothing
    pending and are dealt out by their place."""
    key = (("src_file",) if "src_file" in df.columns else ()) if key is None else key
    got = with_marks(parse_auth_log(df))
    alone = F.when(F.col("pid").isNull(), F.xxhash64(*order))
    before = Window.partitionBy(*key, "pid", alone).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(F.col("_mark").isNotNull(), F.col("_mark")).when(F.col("_ip").isNotNull(), "")
    pending = F.nullif(F.last(state, ignorenulls=True).over(before), F.lit(""))
    got = got.withColumn("_pending", F.when(F.col("pid").isNotNull(), pending))
    fires = F.col("_mark").isNull() & F.col("_pending").isNotNull() & F.col("_ip").isNotNull()
    marks = F.col("_mark").isNotNull() & F.col("pid").isNotNull()
    null = F.lit(None).cast("string")
    return (
        got.withColumn("kind", F.when(marks, "ignore").when(fires, "scanner_probe").otherwise(F.col("kind")))
        .withColumn("reason", F.when(marks, null).when(fires, F.col("_pending")).otherwise(F.col("reason")))
        .withColumn("client_ip", F.when(marks, null).when(fires, F.col("_ip")).otherwise(F.col("client_ip")))
        .withColumn("user", F.when(marks | fires, null).otherwise(F.col("user"))).drop("_mark", "_ip", "_pending")
    )


def scan_mixed(df: DataFrame) -> DataFrame:
    """format (combined, json, ssh) and the columns of the first parser that takes the line. Only a
    line with a brace goes to the second, and only what both refuse to the ssh parser, with its
    pairing by process where rows have ts_sec and row_id. Only lines that name a process are paired,
    and shuffled; they are told apart before any line is parsed, all others are parsed once."""
    cols = ("client_ip", "method", "uri", "status", "referer", "user_agent")
    names = df.columns
    taken, line, ssh = F.coalesce("_a", "_b"), F.col("line"), ("client_ip", "kind", "reason")
    process = F.coalesce(line.rlike(r"sshd\[[0-9]+\]"), F.lit(False))

    def web(rows: DataFrame) -> DataFrame:
        got = seam(parse_combined(rows).select(*names, held(F.when(F.col("parse_ok"), F.struct(*cols))).alias("_a")))
        brace = F.when(F.col("_a").isNull() & F.ltrim("_line").startswith("{"), F.col("_line"))
        got = parse_json(got.withColumnRenamed("line", "_line").withColumn("line", held(brace)), replay=True)
        return seam(got.select(*("_line" if c == "line" else c for c in names), "_a", held(F.when(F.col("parse_ok"), F.struct(*cols))).alias("_b")).withColumnRenamed("_line", "line"))

    def told(rows: DataFrame) -> DataFrame:
        known = F.coalesce(F.col("_ssh.kind") != "ignore", F.lit(False))
        kind = F.when(F.col("_a").isNotNull(), "combined").when(F.col("_b").isNotNull(), "json").when(known, "ssh")
        ip = F.coalesce(taken["client_ip"], F.col("_ssh.client_ip"))
        return seam(rows.select(*names, kind.alias("format"), ip.alias("client_ip"), *(taken[c].alias(c) for c in cols[1:]), *(F.when(known, F.col(f"_ssh.{c}")).alias(c) for c in ssh[1:])))

    paired = {"ts_sec", "row_id"} <= set(names)
    alone = web(df)
    if paired:
        alone = alone.where(taken.isNotNull() | ~process)
    alone = alone.withColumnRenamed("line", "_line").withColumn("line", held(F.when(taken.isNull(), F.col("_line"))))
    alone = parse_auth_log(alone).withColumn("_ssh", held(F.when(taken.isNull(), F.struct(*ssh)))).drop("line").withColumnRenamed("_line", "line")
    if not paired:
        return told(alone)
    rest = parse_auth_log_stateful(web(seam(df).where(held(process))).where(taken.isNull()))
    return told(alone).unionByName(told(rest.withColumn("_ssh", F.struct(*ssh))))


def format_kind(body: Column) -> Column:
    """json, edge (a proxy's address before the others), combined or custom, by the variables of a
    format's body."""
    text = F.trim(body)
    has = lambda *names: _all(text.contains(n) for n in names)
    plain = ~text.contains("$host") & ~text.contains("$request_method") & ~text.contains("$request_uri")
    edge = plain & has("$http_cf_connecting_ip", "$remote_user", "$request", "$status")
    combined = plain & has("$remote_addr", "$remote_user", "$request", "$status", "$body_bytes_sent")
    return F.when(text.startswith("{") & text.endswith("}"), "json").when(edge, "edge").when(combined, "combined").otherwise("custom")


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def classify_log_files(df: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(src_file, kind, format) from lines(src_file, line_key, line): error, json or access; archives
    are left out. Only the first ten lines of a file are looked at. The format of an access file is
    that of catalog(path, format), see resolve_log_catalog, else combined."""
    name = F.lower(F.element_at(F.split("src_file", "/"), -1))
    n = F.row_number().over(Window.partitionBy("src_file").orderBy("line_key"))
    head = df.where(~name.rlike(r"\.(gz|zip|tmp)$")).withColumn("n", n).where("n <= 10 AND trim(line) <> ''")
    first5 = F.min_by(F.when(F.col("n") <= 5, F.col("line")), F.when(F.col("n") <= 5, F.col("n")))
    got = head.groupBy("src_file").agg(first5.alias("five"), F.min_by(F.trim("line"), "n").alias("ten"))
    named = name.contains("error.log") | (name.contains("error") & name.contains(".log"))
    levels = F.col("five").rlike(r"\[(error|warn|crit|alert|emerg)\]")
    kind = F.when(named | levels, "error").when(F.col("ten").startswith("{") & F.col("ten").endswith("}"), "json").otherwise("access")
    got = got.select("src_file", kind.alias("kind"))
    if catalog is None:
        body = F.lit(COMBINED)
    else:
        got, body = got.join(catalog.select(F.col("path").alias("src_file"), F.col("format").alias("_f")), "src_file", "left"), F.coalesce("_f", F.lit(COMBINED))
    return got.select("src_file", "kind", F.when(F.col("kind") == "access", format_kind(body)).otherwise(F.col("kind")).alias("format"))


def resolve_log_catalog(paths: DataFrame, formats: DataFrame) -> DataFrame:
    """(path, format): paths(path, format_name, seq) joined to formats(format_name, body); the
    first declaration of a path counts; unknown names mean the combined format."""
    first = paths.groupBy("path").agg(F.min_by("format_name", "seq").alias("format_name"))
    return first.join(formats, "format_name", "left").select("path", F.coalesce("body", F.lit(COMBINED)).alias("format"))


def read_ip2asn(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')")
    return ip2asn_rows(rows.select(F.col("value").alias("line")))


def ip2asn_rows(df: DataFrame) -> DataFrame:
    """(start_ip, end_ip, asn, country, as_org) of tab-separated lines; what does not parse goes."""
    p = F.split("line", "\t")
    got = df.select(ip_v4(p[0]).alias("start_ip"), ip_v4(F.get(p, F.lit(1))).alias("end_ip"), F.get(p, F.lit(2)).try_cast("long").alias("asn"), F.get(p, F.lit(3)).alias("c"), F.get(p, F.lit(4)).alias("as_org"))
    got = got.where("start_ip IS NOT NULL AND end_ip IS NOT NULL AND asn IS NOT NULL AND as_org IS NOT NULL")
    return got.select("start_ip", "end_ip", "asn", F.when(F.length("c") >= 2, F.substring("c", 1, 2)).otherwise("??").alias("country"), "as_org")


def read_blocklist_maps(df: DataFrame) -> DataFrame:
    """(kind, token) of `map $http_user_agent` and `map $http_referer` blocks in lines(src_file,
    line_key, line)."""
    line = F.trim("line")
    header = F.when(line.rlike(r"^map\s+\$http_user_agent"), "agent").when(line.rlike(r"^map\s+\$http_referer"), "referer").when(line.startswith("}"), "")
    w = Window.partitionBy("src_file").orderBy("line_key")
    got = df.withColumn("_h", header).withColumn("kind", F.last("_h", ignorenulls=True).over(w)).where("_h IS NULL AND kind <> ''")
    key = F.regexp_extract(line, r"""^("[^"]*"|'[^']*'|\S+)\s+(\S+)""", 1)
    value = F.regexp_extract(line, r"""^("[^"]*"|'[^']*'|\S+)\s+(\S+)""", 2)
    got = got.where((key != "") & ~key.isin("default", "include") & (value != "0;"))
    token = F.regexp_replace(F.regexp_replace(F.regexp_replace(key, r"""^["']|["']$""", ""), r"^~\*|\(\?:\\b\)|\\b", ""), r"\\\.", ".")
    return got.select("kind", token.alias("token")).where("token <> ''").distinct()
