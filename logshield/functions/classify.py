"""Scalar rules over a request table: URIs, agents, headers, probes. All native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logshield.functions import signatures as S
from logshield.functions.ip import is_ip, is_private
from logshield.functions.patterns import checked

_BAD_URI = "%00|\\x00|%0[dD]|%0[aA]|\\r|\\n"


def held(value: Column) -> Column:
    """The value, in a form that the optimizer does not copy into filters and projections above it:
    a long expression stays computed once a row."""
    return F.when(F.rand(1) + F.rand(2) < 3, value)


def seam(rows: DataFrame) -> DataFrame:
    """The rows as they are, in as many partitions: no shuffle. Generated code ends here and begins
    anew, so that long expressions on either side are methods of their own; the JVM does not compile
    a method over 8,000 bytes of code, and runs it many times slower. Nor does the optimizer merge
    the two sides."""
    return rows.coalesce(1 << 24)


def malicious_uri(uri: Column) -> Column:
    return uri.rlike(_BAD_URI)


def normalized_path(uri: Column) -> Column:
    """Separators, plain or escaped, collapse to one slash and `%2e` becomes a dot, in one pass;
    other escapes stay. Only texts that need it are rewritten."""
    clean = F.regexp_replace(F.regexp_replace(uri, "(?:%2[fF]|%5[cC]|[/\\\\])+", "/"), "%2[eE]", ".")
    return F.when(uri.rlike("%|\\\\|//"), clean).otherwise(uri)


def resolved_ip(cf: Column, xff: Column, remote: Column) -> Column:
    """Client address from the edge header, the forwarded chain and the peer, in that order."""
    edge = F.trim(F.get(F.split(cf, ","), F.lit(0)))
    hops = F.filter(F.transform(F.split(xff, ","), lambda h: F.trim(h)), is_ip)
    public = F.get(F.filter(hops, lambda h: ~is_private(h)), F.lit(0))
    peer = F.when(is_ip(F.trim(remote)), F.trim(remote))
    return F.coalesce(F.when(is_ip(edge), edge), public, peer, F.get(hops, F.lit(0)))


def _tree_pattern(tokens: list[str]) -> str:
    """A pattern that finds at a place what the alternation of the tokens, in their order, finds, but
    tests common beginnings once."""
    if len(tokens) == 1:
        return re.escape(tokens[0])
    runs: list[tuple[str, list[str]]] = []
    # Only tokens that begin alike compete for a place, so those with another first letter may
    # be passed over; an empty rest ends its run, as what comes after it comes second.
    for t in tokens:
        at = next((k for k in range(len(runs) - 1, -1, -1) if runs[k][0] == t[:1] or not runs[k][0]), None)
        if at is not None and runs[at][0] == t[:1] and t:
            runs[at][1].append(t[1:])
        else:
            runs.append((t[:1], [t[1:]]))
    return "(?:" + "|".join(re.escape(c) + (_tree_pattern(rest) if any(rest) else "") for c, rest in runs) + ")"


def agent_category(agent: Column) -> Column:
    """The category of the leftmost known token; at one place the earlier rule wins."""
    known = {t: c for c, group in S.AGENTS for t in group}
    ascii_low = F.when(F.octet_length(agent) == F.char_length(agent), F.lower(agent)).otherwise(F.translate(agent, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = F.regexp_extract(ascii_low, _tree_pattern(list(known)), 0)
    category = F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.nullif(found, F.lit("")))
    bare = F.trim(F.coalesce(agent, F.lit("")))
    return F.when((bare == "") | (bare == "-"), "empty").otherwise(F.coalesce(category, F.lit("browser_or_unknown")))


def category_from_name(name: Column) -> Column:
    low = F.lower(name)
    known = [c for c, _ in S.AGENTS] + ["empty", "browser_or_unknown"]
    out = F.when(low.isin(*known), low)
    for alias, c in S.ALIASES.items():
        out = out.when(low == alias, c)
    return out


def threat_code(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for c, code in S.CATEGORY_CODES.items():
        out = F.when(name == c, code).otherwise(out)
    return out


def _any(col: Column, marks: tuple[str, ...], test: str = "contains") -> Column:
    out = getattr(col, test)(marks[0])
    for m in marks[1:]:
        out = out | getattr(col, test)(m)
    return out


def header_exploit(value: Column, low: Column | None = None) -> Column:
    """`low` is the value in lower case, where it is a column already: the marks are many."""
    low, out = F.lower(value) if low is None else low, None
    for kind, marks, fold in S.HEADER_EXPLOITS:
        test = _any(low if fold else value, marks)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def referer_exploit(referer: Column, low: Column | None = None) -> Column:
    low, out = F.lower(referer) if low is None else low, None
    for kind, marks in S.REFERER_EXPLOITS:
        out = F.when(_any(low, marks), kind) if out is None else out.when(_any(low, marks), kind)
    return out


def scanner_method(method: Column) -> Column:
    return F.upper(method).isin(*S.SCANNER_METHODS)


def allowed_endpoint(uri: Column, patterns: tuple[str, ...]) -> Column:
    """Does any pattern match somewhere in the uri? A pattern without a form for Java is an error here, with
    its reason, and in no job."""
    return uri.rlike("|".join(f"(?:{p})" for p in checked(patterns))) if patterns else F.lit(False)


def _path_test(path: Column, r: S.Rule) -> Column:
    tests = [_any(path, m, t) for m, t in ((r.has, "contains"), (r.ends, "endswith"), (r.starts, "startswith")) if m]
    out = tests[0] if tests else F.lit(True)
    for t in tests[1:]:
        out = out | t
    return out


def _status_test(status: Column, r: S.Rule) -> Column:
    if r.only == tuple(range(200, 400)):
        return status.between(200, 399)
    return ~status.isin(*r.unless) if r.unless else status.isin(*r.only) if r.only else F.lit(True)


def probe_rule_parts(path: Column, status: Column) -> list[Column]:
    """Parts of the rule chain: the first that is not null has the id of the first rule that holds."""
    def chain(rules, end):
        out = None
        for r in rules:
            test = _path_test(path, r) & _status_test(status, r)
            out = F.when(test, r.id) if out is None else out.when(test, r.id)
        return out.otherwise(end)

    cut = next(i for i, r in enumerate(S.RULES) if r.dotted)
    late = next(i for i, r in enumerate(S.RULES) if r.id == "R29")
    half = (late + len(S.RULES)) // 2
    # Plain traffic with status 200 or 304 skips the last stage's tests.
    rest = F.when(status.isin(200, 304), "R29").otherwise(chain(S.RULES[late + 1 : half], None))
    dotted = F.when(path.contains("/."), chain(S.RULES[cut:late], None))
    return [chain(S.RULES[:cut], None), dotted, rest, chain(S.RULES[half:-1], "R99")]


def probe_rule(path: Column, status: Column) -> Column:
    """Id of the first probe rule that holds."""
    return F.coalesce(*probe_rule_parts(path, status))


def with_probe_rule(rows: DataFrame) -> DataFrame:
    """rows(path, status) with `rule`, the chain cut into parts that are small enough to be compiled."""
    for part in probe_rule_parts(F.col("path"), F.col("status")):
        found = part if "rule" not in rows.columns else F.when(F.col("rule").isNull(), part).otherwise(F.col("rule"))
        rows = seam(rows.withColumn("rule", found))
    return rows


def _decisions() -> list[str]:
    """`kind|category|threshold|window` of each rule for GET and HEAD, for those with QUERY, and for the
    other methods, rule by rule."""
    out = []
    for r in S.RULES:
        for name in ("GET", "QUERY", ""):
            kind, n = r.kind, r.threshold
            if r.safe and name not in r.safe:
                kind, n = (r.kind, r.other) if r.other else ("instant", None)
            out.append("|".join(str(x) for x in (kind, r.category or "", *((n, r.window) if n else ("", "")))))
    return out


def probe_decision(method: Column, status: Column, rule: Column) -> Column:
    """`kind|category|threshold|window` of a rule id for a method: kind is pass, instant, shared
    or isolated; an array is read at the place of rule and method class."""
    up = F.upper(method)
    group = F.when(up.isin(*S.GH), 1).when(up.isin(*S.SQM), 2).otherwise(3)
    place = F.array_position(F.array(*(F.lit(r.id) for r in S.RULES)), rule).cast("int")
    out = F.get(F.array(*map(F.lit, _decisions())), 3 * (place - 1) + group - 1)
    for r in S.RULES:
        if r.calm:
            out = F.when((rule == r.id) & status.isin(*r.calm) & up.isin(*r.safe), f"pass|{r.category}||").otherwise(out)
    return out


def decision_part(decision: Column, part: str) -> Column:
    """kind, category, threshold or window_s of a decision; null where it has none."""
    at = ("kind", "category", "threshold", "window_s").index(part)
    text = F.nullif(F.get(F.split(decision, "\\|"), F.lit(at)), F.lit(""))
    return text.cast("int") if at > 1 else text


def probe_label(path: Column, allowed: tuple[str, ...] = ()) -> Column:
    out = F.when(allowed_endpoint(path, allowed), "AllowedEndpoint")
    for m in S.PATH_LABELS:
        out = out.when(path.contains(m), m)
    d = probe_decision(F.lit("GET"), F.lit(404), probe_rule(path, F.lit(404)))
    return out.otherwise(F.when(decision_part(d, "kind") == "pass", "Clean").otherwise(decision_part(d, "category")))


def parsed_duration(text: Column) -> Column:
    """struct(seconds, error): seconds of `15m`, `24h` ..., null without an error for `permanent`; what
    does not parse has an error."""
    t = F.trim(text)
    number = F.regexp_extract(t, r"^\+?([0-9]+)[smhd]$", 1).try_cast("decimal(20,0)")
    unit = F.when(t.endswith("s"), 1).when(t.endswith("m"), 60).when(t.endswith("h"), 3600).when(t.endswith("d"), 86400)
    seconds = F.when(t.rlike(r"^\+?[0-9]+[smhd]$"), F.try_multiply(number, unit.cast("decimal(10,0)")).try_cast("long"))
    error = F.when(F.lower(t) == "permanent", None).when(t == "", "empty").when(~t.rlike("[smhd]$"), "unknown unit").when(seconds.isNull(), "bad number")
    return F.struct(seconds.alias("seconds"), error.alias("error"))


def duration_seconds(text: Column) -> Column:
    return parsed_duration(text)["seconds"]


def duration_text(seconds: Column) -> Column:
    """`1d 2h 3m 4s` without zero parts; `0s`."""
    part = lambda n, u: F.when(n > 0, F.concat(n.cast("string"), F.lit(u)))
    s = seconds.cast("long")
    made = F.concat_ws(" ", part(F.floor(s / 86400), "d"), part(F.floor(s % 86400 / 3600), "h"), part(F.floor(s % 3600 / 60), "m"), part(s % 60, "s"))
    return F.when(made == "", "0s").otherwise(made)


def datetime_text(epoch: Column) -> Column:
    """`D Mon YYYY HH:MM:SS UTC`."""
    months = "Jan Feb Mar Apr May Jun Jul Aug Sept Oct Nov Dec".split()
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))
    t = F.pmod(epoch, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(t / 3600), two(t % 3600 / 60), two(t % 60))
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(F.array(*map(F.lit, months)), F.month(day)), F.year(day).cast("string"), clock, F.lit("UTC"))
