"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Spans that the base patterns accept always stand. Wider patterns propose further candidates; on every
candidate, base ones included, six labelers vote for, against or not at all: the base pattern, the checks
of a number (Luhn, value ranges, digit counts), a gazetteer (top-level domains, card issuers, calling
codes, reserved networks), context words in front of it, its borders, and its layout. Vote patterns
are counted over all documents. Expectation-maximisation estimates from these counts, without any label, how reliable
each labeler is per kind and how likely a pattern is personal data; a logistic regression on votes and on the
span's shape learns these likelihoods and takes the further candidates it finds likely.

The driver sees one count per (kind, votes, shape): at most 4 x 729 x 144 rows, however large the
corpus. All scans are linear in the text, also over long runs of letters or digits.

Defined results
    null or empty text   no spans, and the hash of the empty text
    equal texts          equal spans; repeated rows and null ids are kept as they are
    overlaps             a further span never meets a base span; of two further ones the first stays,
                         of two with one beginning the likelier
    no candidates        nothing is learned and nothing added
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tillwatch.llm.common import stored, text_slices

KINDS = ["email", "ip", "card", "phone"]
LABELERS = ["pattern", "check", "gazetteer", "context", "border", "layout"]
LEAST_LIKELY = 0.9  # a further span needs this probability
ROUNDS = 200
CONTEXT_CHARS = 40

# Public gazetteers and context words.
TOP_LEVELS = set("com org net edu gov mil int info biz name pro dev app io co me tv de fr es it nl be at ch se no dk fi pl cz pt ie uk "
                 "eu us ca mx br ar cl jp cn kr in au nz za ru ua tr gr hu ro bg il sg hk tw th my id ph vn".split())
CALLING_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 "
                    "91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 962 966 971 972".split())
CUES = {
    "email": "mail email contact write reach courriel correo e-mail".split(),
    "ip": "ip ipv6 host server login address addr gateway subnet".split(),
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta cc".split(),
    "phone": "phone tel telephone call mobile cell fax telefon whatsapp sms".split(),
}
COUNTER_CUES = set("version isbn issn id order invoice serial section chapter figure table page release build rev sku part ticket date".split())

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that begins inside a run of digits exists only where one begins at the run, so runs are
# taken whole; that keeps the scans linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_ONE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# A pattern is tried only on texts that hold what no match of it is without.
_AT = re.compile(r"[ \[({]at[ \])}]", re.I)
_LONG_NUMBER = re.compile(r"[0-9]{4}[._/ -]{1,3}[0-9]{4}")
_NUMBERS = re.compile(r"[0-9]\)?[ .-][0-9]{3}")
_DOT = re.compile(r"\[\.\]|\(\.\)|\[dot\]", re.I)
_WIDER = [
    ("email", _AT.search, re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[({]at[\])}] ?| at )[A-Za-z0-9-]{1,63}+"
                         r"(?:(?: ?[\[({]dot[\])}] ?| dot |\.)[A-Za-z0-9-]{1,63}+){1,4}", re.I)),
    ("ip", _DOT.search, re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])")),
    ("ip", lambda text: text.count(":") >= 7, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", _LONG_NUMBER.search, re.compile(r"(?<![0-9])[0-9]{4}([._/ -]{1,3})[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")),
    ("phone", _NUMBERS.search, re.compile(r"(?<![0-9+])(?:(?:00|\+)[1-9][0-9]{0,2}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
]
_HINT = r"[@0-9:]|(?i:[ \[({]at[ \])}])"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain: every match holds exactly one at sign, so
    each sign is looked at once, with the run of local characters in front of it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _cards(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            yield m.start(), m.end(), m[0].replace(" ", "").replace("-", "")


def _is_card(digits: str) -> bool:
    return 16 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by kind, then by place."""
    found = [("email", s, e) for s, e in emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    found += [("card", s, e) for s, e, digits in _cards(text) if _is_card(digits)]
    found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def further_spans(text: str, base: list[Span]) -> list[Span]:
    """What the wider patterns propose outside the base spans, by place. They may overlap each other."""
    found = {(kind, m.start(), m.end()) for kind, has, pattern in _WIDER if has(text) for m in pattern.finditer(text)}
    for s, e, digits in _cards(text):
        if not _is_card(digits):  # the chain, if short enough, and the numbers that it runs together
            found |= {("card", s, e)} if 13 <= len(digits) <= 19 else set()
            found |= {("card", m.start(), m.end()) for m in _ONE_CARD.finditer(text, s, e)}
    found |= {("ip", m.start(), m.end()) for m in _IP.finditer(text) if not all(map(_small, m[0].split(".")))}
    taken = sorted((s, e) for _, s, e in base)
    out, k = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], x[2], x[0])):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        # Base spans of different kinds may overlap, so some of those that follow are looked at as well.
        if not any(a < e and s < b for a, b in taken[k : k + len(KINDS) * 4]):
            out.append((kind, s, e))
    return out


def chosen(spans: list[tuple[Span, float]]) -> list[Span]:
    """Of overlapping spans the first stays, of those with one beginning the likeliest, then the longest."""
    out, end = [], -1
    for (kind, s, e), _ in sorted(spans, key=lambda x: (x[0][1], -x[1], -x[0][2], x[0][0])):
        if s >= end:
            out.append((kind, s, e))
            end = e
    return out


# --- labelers: +1 personal data, -1 not, 0 no opinion ---------------------------------------


def _plain(kind: str, span: str) -> str:
    """A span without the disguise that the wider patterns allow."""
    if kind == "email":
        span = re.sub(r" ?[\[({]at[\])}] ?| at ", "@", span, count=1, flags=re.I)
        return re.sub(r" ?[\[({]dot[\])}] ?| dot ", ".", span, flags=re.I)
    return re.sub(r"\[\.\]|\(\.\)|\[dot\]", ".", span, flags=re.I) if kind == "ip" else span


def _check(kind: str, span: str) -> int:
    digits = _digits(span)
    if kind == "email":
        return 1 if re.fullmatch(r"[^@]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", span) else -1
    if kind == "ip":
        return 1 if ":" in span or all(map(_small, span.split("."))) else -1
    if kind == "card":
        return 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    return 1 if 8 <= len(digits) <= 15 and len(set(digits)) > 2 else -1


def _gazetteer(kind: str, span: str) -> int:
    digits = _digits(span)
    if kind == "email":
        return 1 if span.rsplit(".", 1)[-1].lower() in TOP_LEVELS else -1
    if kind == "ip":
        first = span.split(".")[0]
        return 0 if ":" in span else -1 if int(first[:4]) in (0, 127) else 1
    if kind == "card":
        two, four = int(digits[:2] or 0), int(digits[:4] or 0)
        known = digits[:1] == "4" or 51 <= two <= 55 or 2221 <= four <= 2720 or two in (34, 35, 36, 37, 38, 62, 65) or four == 6011
        return 1 if known else -1
    code = digits.lstrip("0") if span.startswith("00") else digits if span.startswith("+") else ""
    return 0 if not code else 1 if any(code[:n] in CALLING_CODES for n in (1, 2, 3)) else -1


def _context(kind: str, before: str) -> int:
    words = re.findall(r"[a-z-]+", before.lower())[-4:]
    return 1 if any(w in CUES[kind] for w in words) else -1 if any(w in COUNTER_CUES for w in words) else 0


def _border(left: str, right: str) -> int:
    glued = left.isalnum() or left in "_=\"'#/" and left != "" or right.isalnum() or right in "_=\"'/" and right != ""
    return -1 if glued else 1


def _layout(kind: str, span: str) -> int:
    if kind == "email":
        return 1 if re.match(r"[A-Za-z][A-Za-z0-9._+-]*@", span) else -1
    if kind == "ip":
        return 1 if ":" in span or not re.search(r"(^|\.)0[0-9]", span) else -1
    if kind == "card":
        return 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}(([ -]|[._/ -]{1,3})[0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", span) else -1
    return 1 if re.search(r"[0-9]{2,4}\)?[ .-]", span) and span.count("(") == span.count(")") else -1


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """The six votes as letters: ``+``, ``-`` or ``0``."""
    span = _plain(kind, text[start:end])
    cast = [
        1 if base else 0, _check(kind, span), _gazetteer(kind, span), _context(kind, text[max(0, start - CONTEXT_CHARS) : start]),
        _border(text[start - 1 : start], text[end : end + 1]), _layout(kind, span),
    ]
    return "".join("-0+"[v + 1] for v in cast)


def _char_class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def shape(text: str, start: int, end: int) -> int:
    """One of 144 shapes: length class, number of kinds of separators, the characters on either side."""
    span = text[start:end]
    length = min(2, (end - start) // 12)
    marks = min(2, len({c for c in span if not c.isalnum()}))
    return ((length * 3 + marks) * 4 + _char_class(text[start - 1 : start])) * 4 + _char_class(text[end : end + 1])


# --- label model and classifier -----------------------------------------------------------------


def _one_hot(patterns: list[str]) -> np.ndarray:
    """(pattern, labeler, vote) with votes in the order ``-0+``."""
    codes = np.array([["-0+".index(c) for c in p] for p in patterns]).reshape(len(patterns), len(LABELERS))
    return np.eye(3)[codes]


def reliabilities(patterns: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns of one kind: (class, labeler, vote) probabilities, and each pattern's likelihood
    of being personal data. The belief that a labeler is mostly right counts as a few votes."""
    seen = _one_hot(patterns)
    belief = 20 * np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])  # class 0, class 1
    rates = np.repeat((belief / belief.sum(1, keepdims=True))[:, None, :], len(LABELERS), axis=1)
    share = 0.5
    likely = np.zeros(len(patterns))
    for _ in range(rounds):
        log = np.einsum("plv,clv->pc", seen, np.log(rates)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - likely).max(initial=0) < 1e-10:
            break
        likely = new
        weight = np.stack([(1 - likely) * counts, likely * counts])
        votes_seen = np.einsum("cp,plv->clv", weight, seen) + belief[:, None, :]
        rates = votes_seen / votes_seen.sum(2, keepdims=True)
        share = (weight[1].sum() + 5) / (counts.sum() + 10)
    return rates, likely


def _features(kind: str, pattern: str, code: int) -> np.ndarray:
    own = np.zeros((len(KINDS), len(LABELERS) * 3 + 3 + 3 + 4 + 4 + 1))
    parts = [_one_hot([pattern]).ravel(), np.eye(3)[code // 48], np.eye(3)[code // 16 % 3], np.eye(4)[code // 4 % 4], np.eye(4)[code % 4], [1.0]]
    own[KINDS.index(kind)] = np.concatenate(parts)
    return own.ravel()


def fit_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression with a small ridge on soft targets, by Newton steps. Weights are damped by their square
    root, so that a rare kind of candidate is not drowned by a frequent one."""
    w = np.zeros(x.shape[1])
    weight = np.sqrt(weight)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 0.01 * w
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(rows: list[tuple[str, str, int, int]]) -> dict[tuple[str, str, int], float]:
    """From (kind, votes, shape, count): the classifier's probability of each combination."""
    if not rows:
        return {}
    soft: dict[tuple[str, str], float] = {}
    for kind in KINDS:
        total: dict[str, int] = {}
        for k, pattern, _, n in rows:
            if k == kind:
                total[pattern] = total.get(pattern, 0) + n
        if total:
            names = sorted(total)
            likely = reliabilities(names, np.array([total[p] for p in names], float))[1]
            soft |= {(kind, p): float(v) for p, v in zip(names, likely)}
    x = np.stack([_features(k, p, c) for k, p, c, _ in rows])
    w = fit_classifier(x, np.array([soft[k, p] for k, p, _, _ in rows]), np.array([n for *_, n in rows], float))
    chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {(k, p, c): float(v) for (k, p, c, _), v in zip(rows, chance)}


# --- jobs --------------------------------------------------------------------------------------

_CANDIDATE = "kind:string,first:int,last:int,base:boolean,votes:string,shape:int"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array ``found`` of all candidates of each row, with votes and shape."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = f"doc_id {dict(rows.dtypes)['doc_id']}, found array<struct<{_CANDIDATE}>>"
    empty = rows.sparkSession.createDataFrame([], out).schema
    list_type = to_arrow_type(empty["found"].dataType)

    def judge(text: str) -> list[dict]:
        base = base_spans(text)
        every = [(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in further_spans(text, base)]
        return [
            {"kind": k, "first": s, "last": e, "base": own, "votes": votes(text, k, s, e, own), "shape": shape(text, s, e)}
            for k, s, e, own in every
        ]

    def scan(batches):
        for batch in batches:
            for start, part in text_slices(batch.column(1)):
                hinted = np.asarray(pc.match_substring_regex(part, _HINT))
                found = [judge(part[i].as_py()) if h else [] for i, h in enumerate(hinted.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(part)), pa.array(found, list_type)], names=["doc_id", "found"]
                )

    return rows.mapInArrow(scan, out)


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_LIKELY) -> DataFrame:
    """doc_id, counts and hash of the base spans, ``n_added`` further ones, and all spans as text."""
    found = stored(candidates(docs, id_col, text_col), "span-candidates")
    one = found.select(F.explode("found").alias("c")).select("c.*")
    counted = one.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n")).collect()  # at most 4 x 729 x 144 rows
    chance = learn(sorted((r["kind"], r["votes"], r["shape"], r["n"]) for r in counted))
    taken = {key: p for key, p in chance.items() if p >= least}
    schema = f"doc_id {dict(found.dtypes)['doc_id']}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"

    def finish(batches):
        for batch in batches:
            rows = []
            for every in batch.column(1).to_pylist():
                base = [(c["kind"], c["first"], c["last"]) for c in every if c["base"]]
                keys = [(c, (c["kind"], c["votes"], c["shape"])) for c in every if not c["base"]]
                added = chosen([((c["kind"], c["first"], c["last"]), taken[key]) for c, key in keys if key in taken])
                kinds = [k for k, _, _ in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(base + added), len(added)))
            columns = list(zip(*rows)) if rows else [[] for _ in range(len(KINDS) + 3)]
            types = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    return found.mapInArrow(finish, schema)
