"""Credentials in code, configuration and commands: find them and mask the values alone (problem 5).

A trigram index says which chunks a detection regex can match at all. Each Arrow batch of texts is one block of the
index: the trigrams that any regex requires are looked up in a table of the 2^24 byte triples, which gives the posting
list of every required trigram (a row of a bit matrix over the block's chunks). The requirement of a regex is derived
from its syntax tree as AND/OR of trigrams; postings are intersected and united accordingly, and the regex runs over the
chunks that are left, and nowhere else. A block needs nothing but its own rows, so there is no shuffle, no skew and no
global index to keep; the table is a constant 32 MB in each Python worker.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from re import _constants as C
from re import _parser as P

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import free_name

# --- what a regex requires -------------------------------------------------------------------------------------------

ANY = ("any",)
MOST = 64


def _and(a: tuple, b: tuple) -> tuple:
    if a == ANY or b == ANY:
        return b if a == ANY else a
    return ("and", a, b) if a != b else a


def _or(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ANY if ANY in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_string(s: str) -> tuple:
    out = ANY
    # Letters beyond ASCII aren't folded in the index, so no trigram may hold one that has two cases.
    for part in re.split("|".join({re.escape(c) for c in s if not c.isascii() and c.lower() != c.upper()}) or r"(?!)", s.lower()):
        raw = part.encode()
        for i in range(len(raw) - 2):
            out = _and(out, ("tri", raw[i : i + 3]))
    return out


def _of_strings(strings: set[str]) -> tuple:
    return _or([_of_string(s) for s in sorted(strings)])


def _strings(op: object, arg: object) -> set[str] | None:
    """The strings that one node of a syntax tree can match, lower-cased, if they are few."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                out |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}
    if op is C.SUBPATTERN:
        return _sequence(arg[3])[0]
    if op is C.BRANCH:
        sets = [_sequence(x)[0] for x in arg[1]]
        return None if None in sets or sum(map(len, sets)) > MOST else set().union(*sets)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
        inner = _sequence(arg[2])[0]
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence(ops: object) -> tuple[set[str] | None, tuple]:
    """The strings that a sequence can match (None if many), and the trigrams that it requires."""
    need, run, whole = ANY, {""}, True
    for op, arg in ops:
        s = _strings(op, arg)
        if s is not None and len(run) * len(s) <= MOST:
            run = {a + b for a in run for b in s}
            continue
        need, whole = _and(need, _of_strings(run)), False
        run = s if s is not None else {""}
        if s is None:
            if op is C.SUBPATTERN:
                need = _and(need, _sequence(arg[3])[1])
            elif op is C.BRANCH:
                need = _and(need, _or([_sequence(x)[1] for x in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                need = _and(need, _sequence(arg[2])[1])
    return (run if whole else None), _and(need, _of_strings(run))


def required_trigrams(pattern: str) -> tuple:
    """What any match of ``pattern`` contains, ignoring case, as a tree of ``and``, ``or`` and ``tri`` nodes."""
    return _sequence(P.parse(pattern))[1]


# --- detection -------------------------------------------------------------------------------------------------------

# Names of settings whose values are secret, as the last part of a longer name in any case style.
NAME = r"(?:secret(?:[_-]?(?:access[_-]?)?key)?|passw(?:or)?d|passwort|contraseña|passphrase|pwd|pass|(?:auth|access|api|bearer|refresh|session)?[_-]?token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|_key)"

# The published openings of providers' keys and the signs of what follows, one entry each. A body of fewer
# than 16 signs is too short for a key of any of them.
PROVIDERS = {
    "aws_access_key_id": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "github_token": r"gh[oprsu]_[A-Za-z0-9]{16,}",
    "github_fine_grained": r"github_pat_[A-Za-z0-9_]{22,}",
    "gitlab_token": r"gl(?:pat|dt|rt|ptt|oas)-[A-Za-z0-9_-]{20,}",
    "google_api_key": r"AIza[A-Za-z0-9_-]{35}",
    "google_oauth": r"ya29\.[A-Za-z0-9_-]{20,}",
    "hugging_face": r"hf_[A-Za-z0-9]{30,}",
    "json_web_token": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "model_provider": r"sk-(?:[a-z0-9]+-)*[A-Za-z0-9_-]{16,}",
    "npm_token": r"npm_[A-Za-z0-9]{36}",
    "pypi_token": r"pypi-AgE[A-Za-z0-9_-]{40,}",
    "sendgrid": r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    "slack": r"xox[abeoprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"(?:sk|rk|whsec)_(?:live_|test_)?[A-Za-z0-9]{24,}",
    "named_by_kind": r"[a-z]+_(?:key|tok|token|pat|secret|sk)_[A-Za-z0-9]{16,}",
}
KEYS = "(?:" + "|".join(PROVIDERS.values()) + ")"

# A regex for each form; the secret is in group v (and w where it is split). No length has an upper bound: a value reaches
# to the sign that ends it. What stands before a name is looked up where the name was found.
PATTERNS: dict[str, str] = {
    "provider_key": rf"(?<![A-Za-z0-9_-])(?P<v>{KEYS})",
    "private_key": r"(?P<v>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)",
    "bearer": r"(?i)\bbearer\s+(?P<v>[A-Za-z0-9._~+/=-]{16,})",
    "basic": r"(?i)\bbasic\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])",
    "header_key": r"(?i)\b(?:x-api-key|x-auth-token|x-access-token|api-key|apikey)[\"']?\s*[:=]\s*[\"']?(?P<v>[A-Za-z0-9+/=_.~-]{16,})",
    "connection": r"(?<=[A-Za-z0-9])://[^\s:/@\"']*:(?P<v>[^\s@/\"']{3,})@(?=[A-Za-z0-9\[])",
    "webhook": r"(?i)\bhttps?://(?:[a-z0-9.-]*\bhooks?\b[a-z0-9.-]*/|[a-z0-9.-]+/(?:[a-z0-9_-]+/)*(?:web)?hooks?/)(?P<v>[A-Za-z0-9_/-]{20,})",
    "url_parameter": r"(?i)[?&](?:access_token|auth_token|api_?key|token|auth|key|sig|signature|secret|password|pwd|client_secret)=(?P<v>[^\s&\"'#<>]{12,})",
    "assignment": rf"(?i)(?P<k>{NAME})[\"']?\s*(?::=|=>|[:=])\s*(?P<q>[\"'`]?)(?P<v>[^\s\"'`])",
    "element": rf"(?i)(?P<k>{NAME})>(?P<v>[^<>\n]{{4,}})</",
    "split_key": r"(?i)(?:key|secret|token|passw(?:or)?d)[\"']?\s*[:=]\s*[\"'](?P<v>[A-Za-z0-9+/=_-]{6,})[\"']\s*\+\s*[\"'](?P<w>[A-Za-z0-9+/=_-]{4,})[\"']",
    "said_password": r"(?i)\b(?:password|passwort|kennwort|contraseña|passphrase|passcode)\s+(?:is|was|ist|lautet|es|now)\s+[\"'`]?(?P<v>[^\s\"'`]{6,})",
    "password_of": r"(?i)\b(?:password|passwort|kennwort|contraseña|clave|passphrase|token)\s+(?:for|of|für|von|de|del|para)\s+[^\s:]+\s+(?:is|was|ist|lautet|es|era)\s+[\"'`]?(?P<v>[^\s\"'`]{5,})",
    "password_for": r"(?i)\b(?:passwd|password|passphrase|token)\s+(?:for|of|für|de)\s+[^\s:]+:\s*[\"'`]?(?P<v>[^\s\"'`]{5,})",
    "netrc": r"(?i)\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<v>\S{4,})",
    "login_pair": r"(?i)\b(?:log ?in|sign in|logged in|anmelden|entra)\s+(?:with|as|mit|con)\s+\S+\s?/\s?(?P<v>[^\s,;]{5,})",
    "client_flag": r"(?i)\b(?:mysql|mysqldump|mariadb|mysqladmin|mongo|mongosh|sshpass|clickhouse-client)\b[^\n]*?\s-p\s?(?P<q>[\"']?)(?P<v>[^\s\"']{4,})",
    "cache_flag": r"(?i)\bredis-cli\b[^\n]*?\s-a\s+[\"']?(?P<v>[^\s\"']{4,})",
    "user_flag": r"(?i)\b(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[ =][\"']?[^\s:\"'$]+:(?P<v>[^\s\"']{4,})",
    "long_flag": r"(?i)(?<![\w-])--(?:password|passwd|pass|token|api-key|auth-token|secret|access-key|secret-key)[= ](?P<q>[\"']?)(?P<v>[^\s\"']{6,})",
    "connect_call": r"(?i)\b(?:connect|login|authenticate|create_?client|auth)\(\s*(?:[\"'][^\"'\n]*[\"']\s*,\s*)+[\"'](?P<v>[^\"'\n]{4,})[\"']\s*\)",
    "said_key": r"(?i)(?:\bkey\b[^:\n]*:|密钥[:：是为]?|令牌[:：是为]?)\s*[\"'`]?(?P<v>[A-Za-z0-9+/=_.!@#$%^&*~-]{16,})",
    "said_password_zh": r"(?:密码|口令)(?:[:：]|是|为)\s*[\"'`]?(?P<v>[!-~]{5,})",
    "shown_file": r"(?im)^[^\n]*\b(?:cat|type|less|more|head)\s+\S*(?:credential|secret|token|passwd|\.netrc|\.pgpass|id_rsa)\S*[^\S\n]*\r?\n[^\S\n]*(?P<v>[A-Za-z0-9+/=_.~!@#$%^&*-]{16,})[^\S\n]*\r?$",
}

# Values that stand for a secret without being one.
PLACEHOLDER = re.compile(
    r"(?i)^(?:\$[\w{(]|%[A-Z_]+%$|\{\{|<|\[|\*{2,}|x{4,}|\.{3}|#\{|(?:your|my|the|some|insert|change|replace|enter|put|example|dummy|sample|placeholder|redacted|masked|hidden|todo|none|null|nil|true|false|undefined|empty|secret|password|token)(?:[_\- ]|$)|changeme|xxx)"
    r"|(?:^|[\W_])(?:redacted|masked|placeholder|your[_-]?\w+[_-]here|changeme)(?:$|[\W_])"
)
CODE_VALUE = re.compile(
    r"(?i)(?:(?:os|process|env|sys|config|settings|secrets|conf|vault|std|self|this|args|opts|options|request|req|params|ctx)[.\[(:]|getenv|env\b|lookup|await\b|new\b|new[A-Z(]|function\b|lambda\b|import\b|require\b|async\b|[A-Za-z_][\w.:]*\(|[a-z_]\w*(?:\.\w+)+\s*[;,)]?$|[A-Za-z_]\w*\[)"
)
REST = re.compile(r"[^\n\"'`]*")
NAME_SIGNS = re.compile(r"[\w.-]")
WORD = re.compile(r"(?:(?!</)[^\s;,\"'`])*")
QUOTED_WORD = re.compile(r"[^\s\"'`]*")
SOFT_NAMES = re.compile(r"(?i)(?:token|credentials?|_key|key|pass|secret)$")


def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _is_password(value: str) -> bool:
    """Whether a value reads as a chosen password rather than as a word, a number of a setting or a path."""
    if len(value) < 5 or value.isspace():
        return False
    has_digit, has_sign = any(c.isdigit() for c in value), any(c in "!@#$%^&*?+~=" for c in value)
    return (has_digit and any(c.isalpha() for c in value)) or has_sign or (len(value) >= 8 and any(c.isupper() for c in value) and any(c.islower() for c in value))


def _is_token(value: str) -> bool:
    return len(value) >= 12 and _entropy(value) >= 2.8 and (any(c.isdigit() for c in value) or len({c.isupper() for c in value if c.isalpha()}) == 2 and len(value) >= 20)


def _name_start(text: str, at: int) -> int:
    """Where the name begins that goes on at ``at``."""
    while at and NAME_SIGNS.match(text, at - 1):
        at -= 1
    return at


class Detector:
    """The compiled forms with the trigrams each of them requires."""

    def __init__(self) -> None:
        self.forms = {k: re.compile(v) for k, v in PATTERNS.items()}
        self.needs = {k: required_trigrams(v) for k, v in PATTERNS.items()}
        self.ids: dict[bytes, int] = {}
        for need in self.needs.values():
            self._collect(need)
        self.table = np.full(1 << 24, -1, dtype=np.int16)
        for tri, i in self.ids.items():
            self.table[tri[0] << 16 | tri[1] << 8 | tri[2]] = i

    def _collect(self, need: tuple) -> None:
        if need[0] == "tri":
            self.ids.setdefault(need[1], len(self.ids))
        elif need[0] != "any":
            for x in need[1:]:
                self._collect(x)

    def postings(self, texts: list[str | None]) -> np.ndarray:
        """A row for each required trigram, a column for each text: whether it occurs, ignoring ASCII case."""
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
        out = np.zeros((len(self.ids), len(texts)), dtype=bool)
        data = np.frombuffer(b"\0\0".join(raw), dtype=np.uint8)
        if len(data) < 3:
            return out
        codes = data[:-2].astype(np.int32) << 16
        codes |= data[1:-1].astype(np.int32) << 8
        codes |= data[2:]
        hits = self.table[codes]
        at = np.flatnonzero(hits >= 0)
        ends = np.cumsum([len(r) + 2 for r in raw])
        out[hits[at], np.searchsorted(ends, at, side="right")] = True
        return out

    def _eval(self, need: tuple, postings: np.ndarray) -> np.ndarray:
        if need[0] == "any":
            return np.ones(postings.shape[1], dtype=bool)
        if need[0] == "tri":
            return postings[self.ids[need[1]]]
        parts = [self._eval(x, postings) for x in need[1:]]
        return np.logical_and.reduce(parts) if need[0] == "and" else np.logical_or.reduce(parts)

    def candidates(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """For each form the positions of the texts that can match it."""
        postings = self.postings(texts)
        return {k: np.flatnonzero(self._eval(need, postings)) for k, need in self.needs.items()}

    def matches(self, form: str, text: str) -> Iterator[tuple[int, int, str]]:
        """Start, end and form of each usable secret of one form; the value alone, without quotes."""
        for m in self._assignments(text) if form == "assignment" else self.forms[form].finditer(text):
            start, end = m.span("v")
            value = m["v"]
            if form == "assignment":
                value = self._assigned(m, self._value(m, text), text)
                if value is None:
                    continue
                end = start + len(value)
            elif form == "private_key":
                yield start, self._key_end(text, start, end), form
                continue
            if PLACEHOLDER.search(value) or form == "element" and text[_name_start(text, m.start("k")) - 1 :][:1] != "<":
                continue
            if form in ("client_flag", "cache_flag", "user_flag", "netrc", "login_pair", "connect_call", "said_password", "said_password_zh", "password_of", "password_for", "element") and not _is_password(value):
                continue
            if form in ("bearer", "header_key", "url_parameter", "said_key", "shown_file", "long_flag", "webhook") and not (_is_token(value) or form == "long_flag" and _is_password(value)):
                continue
            if form == "basic" and not self._is_basic(value):
                continue
            yield start, end, form
            if form == "split_key":
                yield *m.span("w"), f"{form}_rest"

    def _assignments(self, text: str) -> Iterator[re.Match]:
        """The settings of a text; the search goes on after the value, since more of them may follow on its line."""
        at = 0
        while m := self.forms["assignment"].search(text, at):
            yield m
            at = m.start("v") + max(1, len(self._value(m, text)))

    @staticmethod
    def _value(m: re.Match, text: str) -> str:
        """The value of a setting: to the closing quote, or to the next separator, however far that is."""
        start = m.start("v")
        if m["q"]:
            line = text.find("\n", start)
            closed = text.find(m["q"], start, line if line >= 0 else len(text))
            return text[start:closed] if closed >= 0 else QUOTED_WORD.match(text, start)[0]
        return WORD.match(text, start)[0]

    @staticmethod
    def _assigned(m: re.Match, value: str, text: str) -> str | None:
        """The value of a setting if it is a secret."""
        name, quote = text[_name_start(text, m.start("k")) : m.end("k")].lower(), m["q"]
        if not quote:
            value = value.rstrip(")}]")
            start = m.start("v")
            if CODE_VALUE.match(text, start, REST.match(text, start).end()) or CODE_VALUE.match(value):
                return None
        if PLACEHOLDER.search(value) or value.startswith("-----") or len(value) < 5:
            return None
        if re.search(r"(?:pass|passw(?:or)?d|passwort|contraseña|passphrase|pwd)$", name):
            return value if _is_password(value) or value.isdigit() and len(value) >= 6 else None
        if value.isdigit() or "://" in value or "/" in value and re.fullmatch(r"[\w.~-]*(?:/[\w.-]+)+", value) and not re.search(r"\d", value):
            return None
        if name.endswith("_key") and not re.search(r"(?:secret|api|access|private|auth)[_-]?(?:access[_-]?)?key$", name):
            return value if quote and _is_token(value) else None
        return value if _is_token(value) or name.endswith("secret") and _is_password(value) else None

    @staticmethod
    def _is_basic(value: str) -> bool:
        import base64
        import binascii

        try:
            return b":" in base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
        except (binascii.Error, ValueError):
            return False

    @staticmethod
    def _key_end(text: str, start: int, end: int) -> int:
        closed = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----").search(text, end)
        if closed:
            return closed.start()
        body = re.compile(r"(?:\s*[A-Za-z0-9+/=\\]{16,})*").match(text, end)
        return body.end() if body else end

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """For each text its secrets in order, without overlap; the first form named wins."""
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for form, at in self.candidates(texts).items():
            for i in at.tolist():
                if texts[i]:
                    for one in self.matches(form, texts[i]):
                        if all(one[1] <= o[0] or one[0] >= o[1] for o in found[i]):
                            found[i].append(one)
        return [sorted(x) for x in found]


def mask(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with each secret value replaced; BEGIN and END lines, quotes and all other signs stay."""
    if not text or not found:
        return text
    out, at = [], 0
    for start, end, form in found:
        if form == "private_key":
            begin = text.find("-----", text.find("-----", start) + 5) + 5
            inner = text[begin:end]
            lead = inner[: len(inner) - len(inner.lstrip())] or ("\\n" if inner.startswith("\\n") else "")
            tail = inner[len(inner.rstrip()) :] or ("\\n" if inner.endswith("\\n") else "")
            out += [text[at:begin], lead, "[redacted:private_key]", tail]
        else:
            out += [text[at:start], f"[redacted:{form}]"]
        at = end
    return "".join([*out, text[at:]])


_detector: Detector | None = None


def _shared() -> Detector:
    """One detector for each Python worker."""
    global _detector
    if _detector is None:
        _detector = Detector()
    return _detector


def find_secrets(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_id`` (long), ``line_no`` (from 1, lines end with a line feed), ``form``: lines in which a secret starts.

    A line with several secrets of a form appears once. Null and empty texts give no row, repeated rows give theirs each,
    very long texts are chunks of the index like any other and are searched as a whole; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = _shared()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for i, t, found in zip(ids, texts, detector.find(texts), strict=True):
                rows += sorted({(i, t.count("\n", 0, start) + 1, form) for start, _, form in found if not form.endswith("_rest")}) if found else []
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["record_id", "line_no", "form"])

    return df.select(F.col(record_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "record_id long, line_no int, form string")


def mask_secrets(df: DataFrame, text: str, *, masked: str = "text_masked", count: str = "secrets_masked") -> DataFrame:
    """``df`` with ``masked``, the text without its secret values, and ``count`` of them.

    Null gives null and 0, an empty text stays empty; equal rows give equal results; an empty table gives an empty one;
    columns of ``df`` that bear one of the new names are replaced.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detector = _shared()
        for texts in batches:
            plain = [x if isinstance(x, str) else None for x in texts]
            found = detector.find(plain)
            yield pd.DataFrame({masked: [mask(t, f) for t, f in zip(plain, found, strict=True)], count: [len(f) for f in found]})

    keep = [c for c in df.columns if c not in (masked, count)]
    both = free_name(df, "both")
    pair = F.pandas_udf(run, f"struct<{masked}: string, {count}: int>")(F.col(text)).alias(both)
    return df.select(*keep, pair).select(*keep, f"{both}.{masked}", f"{both}.{count}")
