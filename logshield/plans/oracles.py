"""SQL of the rule cascade for a second engine, written from the rule data."""

from __future__ import annotations

import re

from logshield.functions import signatures as S
from logshield.plans import views as V


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if "\x00" not in text else "chr(0)"


def _any(col: str, marks: tuple[str, ...], f: str = "contains") -> str:
    return " OR ".join(f"{f}({col}, {q(m)})" for m in marks if "\x00" not in m)


def probe_rule(path: str = "path", status: str = "status") -> str:
    out = []
    for r in S.RULES:
        tests = [_any(path, m, f) for m, f in ((r.has, "contains"), (r.ends, "suffix"), (r.starts, "starts_with")) if m]
        test = "(" + (" OR ".join(tests) or "true") + ")"
        if r.unless:
            test += f" AND {status} NOT IN ({', '.join(map(str, r.unless))})"
        if r.only:
            test += f" AND {status} IN ({', '.join(map(str, r.only))})"
        if r.dotted:
            test += f" AND contains({path}, '/.')"
        out.append(f"WHEN {test} THEN {q(r.id)}")
    return "CASE " + "\n ".join(out) + " END"


def decision(field: str, rule: str = "rule", method: str = "method", status: str = "status") -> str:
    """One field (kind, category, threshold, window_s) of a rule's decision."""
    up, out = f"upper({method})", []
    for r in S.RULES:
        made = lambda kind, n, r=r: {"kind": q(kind), "category": q(r.category) if r.category else "NULL", "threshold": str(n or "NULL"), "window_s": str(r.window if n else "NULL")}[field]
        value = made(r.kind, r.threshold)
        if r.safe:
            other = made(r.kind, r.other) if r.other else made("instant", None)
            value = f"CASE WHEN {up} IN ({', '.join(map(q, r.safe))}) THEN {value} ELSE {other} END"
        if r.calm:
            value = f"CASE WHEN {up} IN ({', '.join(map(q, r.safe))}) AND {status} IN ({', '.join(map(str, r.calm))}) THEN {made('pass', None)} ELSE {value} END"
        out.append(f"WHEN {q(r.id)} THEN {value}")
    return f"CASE {rule} {' '.join(out)} END"


def agent_category(col: str = "user_agent") -> str:
    tokens = [t for _, g in S.AGENTS for t in g]
    found = f"lower(regexp_extract({col}, {q('(?i)(' + '|'.join(map(re.escape, tokens)) + ')')}, 1))"
    groups = " ".join(f"WHEN {found} IN ({', '.join(map(q, g))}) THEN {q(c)}" for c, g in S.AGENTS)
    return f"CASE WHEN trim(coalesce({col}, '')) IN ('', '-') THEN 'empty' {groups} ELSE 'browser_or_unknown' END"


def header_exploit(col: str = "user_agent") -> str:
    whens = []
    for kind, marks, fold in S.HEADER_EXPLOITS:
        c = f"lower({col})" if fold else col
        tests = [f"contains({c}, {q(m)})" if m not in "\r\n" else f"contains({c}, chr({ord(m)}))" for m in marks if m != "\x00"]
        whens.append(f"WHEN {' OR '.join(tests)} THEN {q(kind)}")
    return "CASE " + " ".join(whens) + " END"


def referer_exploit(col: str = "referer") -> str:
    return "CASE " + " ".join(f"WHEN {_any(f'lower({col})', m)} THEN {q(k)}" for k, m in S.REFERER_EXPLOITS) + " END"


IP_V4 = "CASE WHEN contains({0}, ':') THEN NULL ELSE CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT) END"
PATH = r"regexp_replace(regexp_replace(uri, '(?:%2[fF]|%5[cC]|[/\\])+', '/', 'g'), '%2[eE]', '.', 'g')"
EVIL = "regexp_matches(uri, '%00|%0[dD]|%0[aA]|\\r|\\n')"


def judged(blocked: tuple[str, ...] = S.BLOCKED_BY_DEFAULT, allowed: str | None = "^/api/.*", source: str = "access_log", extra: str = "NULL") -> str:
    """CTEs facts, cand: every request with its settled action or its strike. `extra` is an
    action reason that comes before the header tests (asn policy), or NULL."""
    names = ", ".join(map(q, blocked))
    endpoint = f"regexp_matches(uri, {q(allowed)})" if allowed else "false"
    return f"""
facts0 AS MATERIALIZED (SELECT *, {PATH} AS path, {EVIL} AS evil, {endpoint} AS endpoint, {agent_category()} AS agent, {header_exploit()} AS exploit, {referer_exploit()} AS refx, {extra} AS pre FROM {source}),
facts1 AS MATERIALIZED (SELECT *, {probe_rule()} AS rule FROM facts0),
facts AS MATERIALIZED (SELECT *, {decision("kind")} AS kind, {decision("category")} AS category, {decision("threshold")} AS threshold, {decision("window_s")} AS window_s FROM facts1),
cand AS MATERIALIZED (SELECT *, CASE
  WHEN starts_with(client_ip, '10.') THEN 'allow'
  WHEN pre IS NOT NULL THEN 'ban|' || pre
  WHEN exploit IS NOT NULL THEN 'perm|header_exploit:' || exploit
  WHEN agent IN ({names}) AND agent IN ('generic_tools', 'empty') THEN
    CASE WHEN evil THEN 'ban|probe:common:immediate_malicious' WHEN NOT endpoint AND kind <> 'pass' THEN 'ban|probe:' || agent || ':tool_probe'
      WHEN status BETWEEN 400 AND 599 THEN 'strike|tool' ELSE 'allow' END
  WHEN agent IN ({names}) THEN 'ban|blocked_bot_category:' || agent
  WHEN upper(method) IN ('PROPFIND', 'DEBUG', 'SEARCH', 'TRACK', 'TRACE') THEN 'ban|scanner_method:' || upper(method)
  WHEN refx IS NOT NULL THEN 'perm|harmful_referer:' || refx
  WHEN endpoint THEN 'allow' WHEN evil THEN 'ban|probe:common:immediate_malicious' WHEN kind = 'pass' THEN 'allow'
  WHEN kind = 'instant' THEN 'ban|probe:' || category || ':instant' ELSE 'strike|' || kind END AS act FROM facts)"""


def verdicts(clock: str = "event") -> str:
    """CTEs after `judged`: verdict(row_id, ts_sec, client_ip, uri, action, reason, permanent, strikes)."""
    gap = "false" if clock == "none" else "coalesce(ts_sec - lag(ts_sec) OVER w > win, false)"
    return f"""
hits0 AS (SELECT row_id, ts_sec, client_ip, uri, agent, split_part(act, '|', 2) AS pool, category,
    CASE WHEN act = 'strike|tool' THEN 10 ELSE threshold END AS lim, CASE WHEN act = 'strike|tool' THEN 10 ELSE window_s END AS win FROM cand WHERE starts_with(act, 'strike')),
hits1 AS (SELECT *, CASE WHEN {gap} OR (pool = 'isolated' AND coalesce(category <> lag(category) OVER w, false)) THEN 1 ELSE 0 END AS fresh FROM hits0
    WINDOW w AS (PARTITION BY client_ip, pool ORDER BY ts_sec, row_id)),
hits2 AS (SELECT *, sum(fresh) OVER (PARTITION BY client_ip, pool ORDER BY ts_sec, row_id) AS run FROM hits1),
hits AS (SELECT *, least(row_number() OVER (PARTITION BY client_ip, pool, run ORDER BY ts_sec, row_id), 255) AS strikes FROM hits2),
verdict AS (
  SELECT row_id, ts_sec, client_ip, uri, CASE WHEN act = 'allow' THEN 'allow' ELSE 'ban' END AS action,
    CASE WHEN act <> 'allow' THEN substr(act, strpos(act, '|') + 1) END AS reason, CASE WHEN act <> 'allow' THEN starts_with(act, 'perm') END AS permanent, CAST(NULL AS INT) AS strikes
  FROM cand WHERE NOT starts_with(act, 'strike')
  UNION ALL
  SELECT row_id, ts_sec, client_ip, uri, CASE WHEN strikes >= lim THEN 'ban' ELSE 'allow' END,
    CASE WHEN strikes >= lim THEN CASE WHEN pool = 'tool' THEN 'tool_error_burst:' || agent ELSE 'probe:' || category || ':' || pool || '_threshold:' || CAST(strikes AS VARCHAR) END END,
    CASE WHEN strikes >= lim THEN false END, CAST(strikes AS INT) FROM hits)"""


def over(ctes: str, select: str) -> str:
    return f"{V.WITH},\n{ctes.strip().strip(',')}\n{select}" if ctes else f"{V.WITH}\n{select}"
