"""PII surrogates: keyed replacements of the same type, gender, script and format.

A surrogate is the image of the entity under a keyed permutation of all strings of its shape:
the shape (kinds of characters, separators, first digits, script) is kept, so formats hold;
equal entities get equal surrogates in every document and task, so references stay together;
and a permutation never maps two entities to one, so they stay distinct, without a table of
entities that would grow with the corpus. The permutations are single cycles longer than one,
so nothing maps to itself. Where an image would collide with something reserved (a listed given
name as the image of a surname, another class of address), the walk along the cycle goes on
until it leaves the reserved part, which keeps the map one-to-one.

Names are recognised by a title, or by a listed given name before a capitalised word; their words
are then names wherever else they stand in the same text. Given names map to names of the same
list, one list per gender and script. A number gets the same national digits whether it is
written with its calling code or without. The key is the caller's: there is no default.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshield.llm.common import slices

#: Surrogates that a task remembers; characters that are permuted as one number.
CACHE, BLOCK = 50_000, 64

GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Carla Clara Elena Emily Emma Eva Isabel Julia Laura Linda Lucia Maria Marie Martha Mary Nina Olivia Paula Rosa Sarah Sofia Susan Teresa".split(),
    ("m", "latin"): "Albert Alexander Carlos Charles David Edward Eric Frank George Hans Henry Ivan James John Jorge Karl Louis Luis Marco Martin Michael Paul Peter Robert Thomas William".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Екатерина".split(),
    ("m", "cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Павел Борис".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora".split()

_LISTED = {n.lower(): k for k, names in GIVEN.items() for n in names}
# Double names and those with an apostrophe are one word.
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿа-яё]+(?:[-'’][A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿа-яё]+)*"
_PATTERNS = (
    ("email", r"(?<![A-Za-z0-9_%+-])(?<![A-Za-z0-9_%+-]\.)[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16,}+|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("phone", r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("name", rf"\b(?:(?:{'|'.join(TITLES)})\.? {_NAME}(?: {_NAME})?|(?:{'|'.join(n for names in GIVEN.values() for n in names)}) {_NAME})\b"),
)
TYPES = ("email", "secret", "iban", "ip", "phone", "card", "ssn", "name")
_FIND = re.compile("|".join(f"(?P<p{i}>{p.replace(chr(92) + '1', '(?P=sep)').replace('([ -])', '(?P<sep>[ -])')})" for i, (k, p) in enumerate(_PATTERNS) if k != "name"))
_NAMED = re.compile(_PATTERNS[-1][1])
_WORD = re.compile(rf"\b{_NAME}\b")
# Every entity but a name holds one of these, and they are less than GAP characters apart in it.
_SIGN, GAP = re.compile(r"[0-9@]|(?<![A-Za-z0-9])(?:sk-|AKIA|gh[pousr]_|github_pat_)"), 100
# What follows a sign may be an account number's last groups, of letters alone.
_GROUPS = re.compile(r"(?: [A-Z]{1,4}(?![A-Za-z0-9]))+")
# Calling codes of one and two digits; the others have three.
_CALLING = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3}")


def _number(key: str, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, (key, *parts))).encode(), digest_size=32).digest(), "big")


def _split(n: int) -> tuple[int, int]:
    """n as a product of two near factors is not always there; the halves cover n or more."""
    a = 1
    while a * a < n:
        a *= 2
    return a, -(-n // a)


def _feistel(x: int, n: int, key: str, tag: str, back: bool) -> int:
    """Keyed permutation of range(n): an alternating network on a covering rectangle, walked
    until it is inside again."""
    a, b = _split(n)
    while True:
        hi, lo = divmod(x, a)
        for r in reversed(range(6)) if back else range(6):
            sign = -1 if back else 1
            if r % 2:
                hi = (hi + sign * _number(key, tag, r, lo)) % b
            else:
                lo = (lo + sign * _number(key, tag, r, hi)) % a
        x = hi * a + lo
        if x < n:
            return x


def step(x: int, n: int, key: str, tag: str) -> int:
    """The next element of a keyed cycle through all of range(n): never x itself if n > 1."""
    return _feistel((_feistel(x, n, key, tag, False) + 1) % n, n, key, tag, True) if n > 1 else x


_VOWELS, _CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
_CYR_VOWELS, _CYR_CONSONANTS = "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _alphabets(text: str, names: bool) -> list[str | None]:
    """For each character, the characters it may become; None: it stays."""
    out: list[str | None] = []
    for c in text:
        low = c.lower()
        if c in "0123456789":
            out.append("0123456789")
        elif names:
            out.append(next((s for s in (_VOWELS, _CONSONANTS, _CYR_VOWELS, _CYR_CONSONANTS) if low in s), None))
        else:
            out.append(_LETTERS if low in _LETTERS else None)
    return out


def _shaped(text: str, alphabets: list[str | None], key: str, tag: str, allowed=lambda s: True) -> str:
    """The image of a text under the cycle of its shape; case is kept by position."""
    low = text.lower()
    use = [i for i, a in enumerate(alphabets) if a]
    if len(use) > BLOCK:
        # A long text block by block, each under a cycle that what stands before it chooses: still one to one.
        out, at, chain = [], 0, hashlib.blake2b(str(len(use)).encode(), digest_size=16)
        for end in [*use[BLOCK::BLOCK], len(text)]:
            out.append(_shaped(text[at:end], alphabets[at:end], key, f"{tag}|{chain.hexdigest()}"))
            chain.update(low[at:end].encode())
            at = end
        return "".join(out)
    n = 1
    for i in use:
        n *= len(alphabets[i])
    shape = tag + "|" + "".join(a[0] + str(len(a)) if a else c for a, c in zip(alphabets, low, strict=True))
    x = 0
    for i in use:
        x = x * len(alphabets[i]) + alphabets[i].index(low[i])
    # The text itself is allowed, so the walk along its cycle ends.
    while True:
        x = step(x, n, key, shape)
        y, chars = x, list(text)
        for i in reversed(use):
            y, d = divmod(y, len(alphabets[i]))
            c = alphabets[i][d]
            chars[i] = c.upper() if text[i].isupper() else c
        made = "".join(chars)
        if allowed(made):
            return made


def _digits(text: str, key: str, tag: str, skip: int = 0, classes: bool = True) -> str:
    """Digits permuted after the first `skip`, which have no part in it; what separates them stays. With classes, digits 0
    and 1 and digits 2 to 9 stay among themselves, as numbering plans want."""
    at = [i for i, c in enumerate(text) if c in "0123456789"]
    at = at[skip:]
    plain = "".join(text[i] for i in at)
    alphabets: list[str | None] = [("01" if c in "01" else "23456789") if classes else "0123456789" for c in plain]
    made = _shaped(plain, alphabets, key, tag)
    chars = list(text)
    for i, c in zip(at, made, strict=True):
        chars[i] = c
    return "".join(chars)


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _card(text: str, key: str) -> str:
    """First digit (the brand) kept, the check digit as right or as wrong as before."""
    digits = re.sub(r"[ -]", "", text)
    body = _shaped(digits[1:-1], ["0123456789"] * (len(digits) - 2), key, "card" + digits[0])
    wanted = luhn(digits)
    body = digits[0] + body
    last = next(str(d) for d in range(10) if luhn(body + str(d)) == wanted)
    new = iter(body + last)
    return "".join(next(new) if c in "0123456789" else c for c in text)


def _address_class(octets: tuple[int, ...]) -> int:
    a, b = octets[:2]
    if a == 10:
        return 1
    if a == 172 and 16 <= b < 32:
        return 2
    if (a, b) == (192, 168):
        return 3
    return 4 if a == 127 else 5 if a == 0 or a >= 224 else 0


def _ip(text: str, key: str) -> str:
    octets = tuple(map(int, text.split(".")))
    x = int.from_bytes(bytes(octets), "big")
    kind = _address_class(octets)
    # Private and other special blocks are permuted inside, the rest as a whole.
    free = {1: 24, 2: 20, 3: 16, 4: 24}.get(kind, 32)
    head, x = x >> free << free, x & ((1 << free) - 1)
    while True:
        x = step(x, 1 << free, key, f"ip{kind}")
        made = tuple((head | x).to_bytes(4, "big"))
        if _address_class(made) == kind:
            return ".".join(map(str, made))


def _iban(text: str, key: str) -> str:
    plain = text.replace(" ", "")
    body = _shaped(plain[4:], [("0123456789" if c in "0123456789" else _LETTERS) for c in plain[4:]], key, "iban" + plain[:2])
    check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    new = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def _valid_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _iban_size(text: str) -> int:
    """Length of the longest valid number that the groups begin with, 0 if there is none: a
    word or number after it may look like a group."""
    while len(text.replace(" ", "")) >= 16:
        if _valid_iban(text):
            return len(text)
        text = text.rpartition(" ")[0]
    return 0


def _given(name: str, key: str) -> str:
    names = GIVEN[_LISTED[name.lower()]]
    return names[step([n.lower() for n in names].index(name.lower()), len(names), key, "given" + "".join(_LISTED[name.lower()]))]


def _name(text: str, key: str) -> str:
    out = []
    for i, word in enumerate(text.split(" ")):
        if i == 0 and word.rstrip(".") in TITLES:
            out.append(word)
        elif word.lower() in _LISTED:
            out.append(_given(word, key))
        else:
            out.append(_shaped(word, _alphabets(word, True), key, "surname", lambda s: s.lower() not in _LISTED))
    return " ".join(out)


def _secret(text: str, key: str) -> str:
    head = next((p for p in ("AKIA", "sk-proj-", "sk-", "github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_") if text.startswith(p)), "")
    body = text[len(head) :]
    if not head:
        made = _shaped(body.lower(), ["0123456789abcdef"] * len(body), key, "hex")
        return made.upper() if body.isupper() else made
    # Upper and lower case stay by position, so case belongs to the shape.
    tag = head + "".join("U" if c.isupper() else "l" for c in body)
    return head + _shaped(body, _alphabets(body, False), key, tag)


def surrogate(kind: str, text: str, key: str) -> str:
    if kind == "email":
        local, _, host = text.rpartition("@")
        stem, _, tld = host.rpartition(".")
        return _shaped(f"{local}@{stem}", _alphabets(f"{local}@{stem}", False), key, "email" + tld.lower()) + "." + tld
    if kind == "phone":
        country = len(_CALLING.match(text, 1)[0]) if text[0] == "+" else 0
        return _digits(text, key, "phone", skip=country)
    return {"card": _card, "ip": _ip, "iban": _iban, "name": _name, "secret": _secret, "ssn": lambda t, k: _digits(t, k, "ssn", classes=False)}[kind](text, key)


def _kind(m: re.Match) -> str:
    return next(_PATTERNS[int(g[1:])][0] for g, v in m.groupdict().items() if v is not None and g != "sep")


def _near_signs(text: str):
    """Parts of a text around digits, at signs and beginnings of secrets, widened to white space
    and over groups of capital letters."""
    at, size = 0, len(text)
    while m := _SIGN.search(text, at):
        a, b = m.start(), m.end()
        while a > at and not text[a - 1].isspace():
            a -= 1
        while True:
            while m := _SIGN.search(text, b, min(b + GAP, size)):
                b = m.end()
            while b < size and not text[b].isspace():
                b += 1
            if not (m := _GROUPS.match(text, b)):
                break
            b = m.end()
        yield a, b
        at = b


def entities(text: str, types: tuple[str, ...] = TYPES) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, in order, not overlapping."""
    out = []
    for a, b in _near_signs(text):
        while m := _FIND.search(text, a, b):
            kind, a = _kind(m), m.end()
            if kind == "iban":
                if not (size := _iban_size(m[0])):
                    continue
                a = m.start() + size
            if kind in types:
                out.append((m.start(), a, kind))
    if "name" in types:
        names = [(m.start(), m.end(), "name") for m in _NAMED.finditer(text)]
        if names:
            names = _mentions(text, names)
        if names and out:
            both = sorted(out + names)
            out = [x for i, x in enumerate(both) if x[2] != "name" or not ((i and both[i - 1][1] > x[0]) or (i + 1 < len(both) and both[i + 1][0] < x[1]))]
        else:
            out += names
    return out


def _mentions(text: str, names: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The names and all other places where one of their words stands alone, in order."""
    words = {w for a, b, _ in names for w in text[a:b].split(" ") if w.rstrip(".") not in TITLES}
    out, k = [], 0
    for m in _WORD.finditer(text):
        while k < len(names) and names[k][1] <= m.start():
            out.append(names[k])
            k += 1
        if m[0] in words and not (k < len(names) and names[k][0] <= m.start()):
            out.append((m.start(), m.end(), "name"))
    return out + names[k:]


def replaced(text: str, key: str, types: tuple[str, ...] = TYPES, made: dict | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities. `made` keeps surrogates for further calls."""
    found = entities(text, types)
    made = {} if made is None else made
    out, at = [], 0
    for a, b, kind in found:
        one = (kind, text[a:b])
        if one not in made:
            if len(made) >= CACHE:
                made.clear()
            made[one] = surrogate(kind, text[a:b], key)
        out += [text[at:a], made[one]]
        at = b
    return ("".join([*out, text[at:]]) if found else text), found


def _batches(batches, key: str, types: tuple[str, ...], name: str):
    made: dict = {}
    for batch in slices(batches):
        texts, spans = [], []
        for t in batch.column(1).to_pylist():
            new, found = replaced(t, key, types, made) if t else (t, [])
            texts.append(new)
            spans.append([{"start": a, "end": b, "type": k} for a, b, k in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())]))
        rest = [batch.column(j) for j in range(2, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *rest, pa.array(spans, kind)], [*batch.schema.names, name])


def pseudonymised(docs: DataFrame, key: str, types: tuple[str, ...] = TYPES, spans: str = "entities") -> DataFrame:
    """docs with surrogates in `text` and a column `spans` (start, end and type in the old text).

    Defined cases: a null text stays null, an empty one empty, with no entities; rows that repeat
    a doc_id are treated each; other columns pass through (one called as `spans` says is replaced);
    a very long text is searched whole, in time and memory in proportion to it. The result of a
    row depends on its text and the key alone."""
    docs = docs.drop(spans)
    docs = docs.select("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{spans}` array<struct<start: long, end: long, type: string>>"
    return docs.mapInArrow(partial(_batches, key=key, types=types, name=spans), schema)


def summary(done: DataFrame) -> DataFrame:
    """doc_id, text, n_entities and a count per type."""
    count = lambda k: F.size(F.filter("entities", lambda e: e["type"] == k)).alias(f"n_{k}")
    return done.select("doc_id", "text", F.size("entities").alias("n_entities"), *(count(k) for k in TYPES), "entities")
