"""Personal data by weak supervision.

Base spans come from fixed patterns with checks. Further candidates (credentials, phone numbers
without a plus sign) are voted on by labelers: the strict shape, words of the context, gazetteers
and the surroundings each say yes, no or nothing. The counts of all vote patterns in the corpus
feed an expectation-maximisation that estimates each labeler's reliability and each pattern's
probability; a logistic span classifier is fitted to these probabilities on span features and
decides which candidates are added. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

KINDS = ("email", "ip", "card", "phone", "secret")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only start at the start of a run of digits, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: A run with a digit; credentials are such runs of 16 characters or more with a letter too.
RUN = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
BARE_PHONE = re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?")
CONTEXT = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "whatsapp"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential"),
}
AGAINST = ("version", "license", "isbn", "commit", "sha", "md5", "uuid", "order", "page", "http", "doi")
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ca", "ch", "at", "it", "nl", "br", "mx")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "xox", "eyJ", "glpat-", "AIza")
LABELERS = 4

CANDIDATE = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("votes", T.IntegerType()), T.StructField("feats", T.IntegerType())])
FOUND = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]] + [T.StructField("base_sha256", T.StringType()), T.StructField("candidates", T.ArrayType(CANDIDATE))])


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int, int]]:
    """Leftmost matches, found from each sign: the run of local characters before it, a domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of valid matches, leftmost non-overlapping per kind."""
    out = emails(text)
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


class _Taken:
    """Places of sorted spans, overlapping ones united."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in spans:
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)
        return k == 0 or self.ends[k - 1] <= s


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and what may be added: (start, kind, end), none overlapping a base span.

    A credential is a run of at least 16 characters with a letter and a digit; a text without any
    digit has neither kind of addition.
    """
    if not DIGIT.search(text):
        return base
    taken = _Taken([(s, e) for s, _, e in base])
    runs = [m.span() for m in RUN.finditer(text) if DIGIT.search(m.group()) and re.search("[A-Za-z]", m.group()) and taken.free(*m.span())]
    more = [(s, 4, e) for s, e in runs]
    secret = _Taken(runs)
    for m in BARE_PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15 and taken.free(*m.span()) and secret.free(*m.span()) and not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in ".-")) and not text[m.end() : m.end() + 1].isalnum():
            more.append((m.start(), 3, m.end()))
    return sorted(base + more)


def _describe(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, int]:
    """Votes of the labelers (base 3: 0 no, 1 nothing, 2 yes) and feature bits of one candidate."""
    span, before, after = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 2]
    words = [w for w in CONTEXT[KINDS[kind]] if w in before]
    hexa = re.fullmatch("[0-9a-fA-F]+", span) is not None
    shape = 2 if base or (kind == 4 and (hexa and len(span) in (32, 40, 64) or len(span) >= 20 and re.search("[a-z]", span) and re.search("[A-Z]", span))) else (0 if kind == 4 and len(span) < 20 else 1)
    against = any(w in before for w in AGAINST)
    context = 2 if words and not against else 0 if against else 1
    if kind == 0:
        known = span.rsplit(".", 1)[-1].lower() in DOMAINS
    elif kind == 1:
        known = 0 < int(span.split(".", 1)[0][-4:]) < 224
    elif kind == 2:
        known = span[0] in "3456"
    elif kind == 3:
        known = span[0] in "+("
    else:
        known = span.startswith(PREFIXES)
    gazetteer = 2 if known else 1
    assigned = re.search(r"[=:]\s*[\"']?$", before) is not None
    quoted = before[-1:] in "\"'" and after[:1] in "\"'" and bool(before[-1:]) and bool(after[:1])
    around = 2 if assigned or quoted or (kind < 4 and not before[-1:].isalnum() and not after[:1].isalnum()) else 0 if kind == 4 else 1
    votes = ((shape * 3 + context) * 3 + gazetteer) * 3 + around
    bits = [shape == 2, bool(words), against, known, assigned, quoted, hexa, len(span) >= 20, len(span) >= 32, bool(re.search("[A-Z]", span)), sum(map(str.isdigit, span)) * 2 > len(span)]
    return votes, (1 << kind) | sum(b << (5 + i) for i, b in enumerate(bits)) | base << FEATURES  # the last bit: stays anyway


FEATURES = 16


@F.pandas_udf(FOUND)
def _find_udf(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        text = text or ""
        base = base_spans(text)
        n = [sum(k == i for _, k, _ in base) for i in range(4)]
        told = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        own = set(base)
        cands = [(k, s, e, *_describe(text, s, k, e, (s, k, e) in own)) for s, k, e in _candidates(text, base)]
        rows.append((*n, hashlib.sha256(told.encode()).hexdigest(), [dict(zip(CANDIDATE.names, c)) for c in cands]))
    return pd.DataFrame(rows, columns=FOUND.names)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns (n, labelers; 0 no, 1 nothing, 2 yes).

    Returns each pattern's probability of being personal, P(vote | class) (2, labelers, 3), and the
    share of personal spans.
    """
    p = np.clip(0.5 + 0.2 * (votes - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        w = np.stack([counts * (1 - p), counts * p])
        prior = (w[1].sum() + 1) / (w.sum() + 2)
        given = np.stack([[[(w[c] * (votes[:, j] == v)).sum() + (2.0 if v == 2 * c else 1.0) for v in range(3)] for j in range(votes.shape[1])] for c in range(2)])
        given /= given.sum(axis=2, keepdims=True)
        log = np.log(given[:, np.arange(votes.shape[1]), votes]).sum(axis=2)
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - prior) / prior), -50, 50)))
    return p, given, prior


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression on soft targets, by Newton steps."""
    w = np.zeros(x.shape[1])
    weight = weight / max(weight.sum(), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - target)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _rows(feats: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(feats), 1)), (feats[:, None] >> np.arange(FEATURES)) & 1], axis=1)


def span_classifier(candidates: DataFrame) -> np.ndarray:
    """Weights learned from all candidates (votes, feats): their pattern counts, bounded in number, come to the driver."""
    rows = candidates.groupBy("votes", "feats").agg(F.count("*").alias("n")).orderBy("votes", "feats").collect()
    if not rows:
        return np.zeros(FEATURES + 1)
    votes, feats, n = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    digits = np.stack([votes // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)], axis=1)
    p, _, _ = reliabilities(digits, n)
    return logistic(_rows(feats), p, n)


def _spans(weights: np.ndarray):
    def one(c: dict) -> bool:
        return bool(_rows(np.array([c["feats"]]))[0] @ weights > 0)

    @F.pandas_udf(T.StringType())
    def udf(candidates: pd.Series) -> pd.Series:
        out = []
        for cs in candidates:
            keep = [c for c in cs if c["feats"] >> FEATURES or one(c)]
            out.append(",".join(f"{KINDS[c['kind']]}:{c['start']}:{c['end']}" for c in sorted(keep, key=lambda c: (c["start"], c["kind"]))))
        return pd.Series(out, dtype="object")

    return udf


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row, offsets in code points.

    Null texts are empty (no spans); repeated rows come back each; ids and other columns are only
    passed by; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(docs.select(F.col(id_col).alias("id"), _find_udf(F.col(text_col)).alias("r")).select("id", "r.*"), "found")
    weights = span_classifier(found.select(F.explode("candidates").alias("c")).select("c.votes", "c.feats"))
    return found.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS[:4]], "base_sha256", _spans(weights)("candidates").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every base span in the text replaced by its kind in brackets; added spans need `personal_data`."""

    @F.pandas_udf(T.StringType())
    def udf(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            out, at = [], 0
            for s, k, e in base_spans(t):
                if s >= at:
                    out += [t[at:s], f"[{KINDS[k].upper()}]"]
                    at = e
            return "".join([*out, t[at:]])

        return texts.map(one)

    return docs.withColumn(text_col, udf(F.col(text_col)))
