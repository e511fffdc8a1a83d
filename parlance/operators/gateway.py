"""The full redaction gateway for texts that hold JSON: values of unknown shape are walked, so this runs in Arrow batches.

A text that is a JSON object or array is parsed, walked and written again with two blanks of indent; then the passes run over
the result as over any text. In the walk, strings under sensitive keys are replaced whole, other strings by the passes; ids
and an existing redaction block are left as they are.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import patterns as P
from parlance.operators.redact import redacted

#: Keys whose string values are copied untouched.
UNTOUCHED = ("session_id", "message_id", "captured_at", "capture_trigger", "aic_version", "provider")


def rx(pattern: str, fold: bool = False) -> re.Pattern:
    return re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII | (re.I if fold else 0))


KEYS = [(rx(p, True), put, category, name) for p, put, category, name in P.KEYS]
INLINE = [(name, rx(p, fold), put, category) for name, p, fold, put, category in P.INLINE]
HEADERS = [(rx(r"Authorization:\s*Bearer\s+[^\s]+", True), "bearer"), (rx(r"Authorization:\s*Basic\s+[A-Za-z0-9+/=]+", True), "basic")]
NAMED, COOKIES, PAIR = rx(r"(X-Api-Key|X-Auth-Token):\s*([^\s]+)", True), rx(P.COOKIES), rx(P.JSON_PAIR)
LINE, ASSIGNED, PARAM = rx(P.KV_LINE), rx(P.INLINE_ASSIGNMENT), rx(P.URL_PARAM)


class Gateway:
    """Counts of what one text held, by category, by placeholder and by pattern."""

    def __init__(self, ignore: tuple[str, ...] = ()):
        self.ignore = [re.compile(p) for p in ignore]
        self.clear()

    def clear(self) -> None:
        self.by_type: Counter[str] = Counter()
        self.by_placeholder: Counter[str] = Counter()
        self.patterns: set[str] = set()

    def hit(self, name: str, placeholder: str, category: str) -> str:
        self.by_type[category] += 1
        self.by_placeholder[placeholder] += 1
        self.patterns.add(name)
        return placeholder

    @staticmethod
    def classify(key: str) -> tuple[str, str, str] | None:
        if key.lower() in P.STRUCTURAL:
            return None
        return next((found[1:] for found in KEYS if found[0].search(key)), None)

    def ignored(self, text: str) -> bool:
        return any(p.search(text) for p in self.ignore)

    def walk(self, value):
        """Any JSON value, redacted."""
        if isinstance(value, str):
            return self.text(value)
        if isinstance(value, list):
            return [self.walk(v) for v in value]
        if not isinstance(value, dict):
            return value
        out = {}
        for k, v in value.items():
            if k == "redacted" or (isinstance(v, str) and k in UNTOUCHED):
                out[k] = v
            elif isinstance(v, str) and (c := self.classify(k)) and not self.ignored(v):
                out[k] = self.hit(f"{c[2]}:field", c[0], c[1])
            else:
                out[k] = self.walk(v)
        return out

    def text(self, text: str) -> str:
        """One string through all passes, in their order."""
        if self.ignored(text):
            return text
        if text.strip()[:1] in ("{", "["):
            try:
                text = json.dumps(self.walk(json.loads(text)), indent=2, ensure_ascii=False)
            except ValueError:
                pass
        for p, kind in HEADERS:
            text = p.sub(lambda m, kind=kind: "Authorization: " + self.hit(f"auth-header:{kind}", f"[AUTH_HEADER:{kind.upper()}]", "auth_header"), text)
        text = NAMED.sub(lambda m: f"{m[1]}: " + self.hit(f"auth-header:{m[1].lower()}", f"[AUTH_HEADER:{m[1].upper().replace('-', '_')}]", "auth_header"), text)
        text = COOKIES.sub(self.cookies, text)
        text = PAIR.sub(self.pair, text)
        text = LINE.sub(self.line, text)
        text = ASSIGNED.sub(self.assigned, text)
        text = PARAM.sub(self.param, text)
        for name, p, put, category in INLINE:
            text = p.sub(lambda m, name=name, put=put, category=category: self.hit(name, put, category), text)
        return text

    def cookies(self, m: re.Match) -> str:
        out = []
        for part in re.split(r";\s*", m[2]):
            name, _, value = part.partition("=")
            out.append(f"{name}={self.hit(f'cookie:{name.lower()}', f'[COOKIE:{name.strip().upper()}]', 'cookie')}" if value.split("=")[0] else part)
        return f"{m[1]}: {'; '.join(out)}"

    def pair(self, m: re.Match) -> str:
        c = self.classify(m[1])
        return f'"{m[1]}": "{self.hit(c[2] + ":json", c[0], c[1])}"' if c else m[0]

    def line(self, m: re.Match) -> str:
        c = None if m[2].lower() in ("authorization", "cookie") else self.classify(m[2])
        if not c:
            return m[0]
        self.text(m[4])  # what stood behind the value is not kept, but counted
        return f"{m[1] or ''}{m[2]}={self.hit(c[2] + ':kv', c[0], c[1])}"

    def assigned(self, m: re.Match) -> str:
        c = None if m[2].startswith("[") and m[2].endswith("]") else self.classify(m[1])
        return f"{m[1]}={self.hit(c[2] + ':inline', c[0], c[1])}" if c else m[0]

    def param(self, m: re.Match) -> str:
        low = m[2].lower()
        put, category, name = self.classify(m[2]) or (f"[URL_PARAM:{m[2].upper()}]", "password" if "password" in low else "url_param", f"url-param:{low}")
        return f"{m[1]}{m[2]}={self.hit(name, put, category)}"

    def risk(self) -> str:
        return "high" if any(self.by_type[c] for c in P.HIGH_RISK) else "medium" if any(self.by_type[c] for c in P.MEDIUM_RISK) else "low"


def parse_ignore(text: str) -> tuple[str, ...]:
    """Patterns parted by line ends or semicolons, bare or as /body/flags; those that are not valid are dropped."""
    out = []
    for part in re.split(r"[\n;]+", text):
        part = part.strip()
        if m := re.fullmatch(r"/(.*)/([a-z]*)", part):
            part = ("(?i)" if "i" in m[2] else "") + m[1]
        try:
            re.compile(part)
        except re.error:
            continue
        if part:
            out.append(part)
    return tuple(out)


def gated(df: DataFrame, id_col: str, col: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """id, text, total, by_type, by_placeholder, patterns and risk_level of each row; a null text stays null."""
    kind = df.schema[id_col].dataType.simpleString()
    counts = pa.map_(pa.string(), pa.int64())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gateway(ignore)
        for b in batches:
            out: list[tuple] = []
            for t in b.column(1).to_pylist():
                g.clear()
                text = None if t is None else g.text(t)
                out.append((text, sum(g.by_type.values()), sorted(g.by_type.items()), sorted(g.by_placeholder.items()), sorted(g.patterns), g.risk()))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.string(), pa.int64(), counts, counts, pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], names=["id", "text", "total", "by_type", "by_placeholder", "patterns", "risk_level"])

    return df.select(id_col, col).mapInArrow(rows, f"id {kind}, text string, total long, by_type map<string,long>, by_placeholder map<string,long>, patterns array<string>, risk_level string")


#: Texts that the column passes cannot settle: JSON blocks, and sensitive lines with more behind the value, which is counted too.
WALKED = rf"^\s*[{{\[]|(?m)^(?:\s*export\s+)?[A-Za-z0-9_.-]*{P.SENSITIVE.replace('(?i)', '(?i:')})[A-Za-z0-9_.-]*\s*[:=]\s*[^\s#]+[^\r\n]*\S"


def sanitized(df: DataFrame, id_col: str, col: str, ignore: tuple[str, ...] = (), walked: bool = True) -> DataFrame:
    """What ``gated`` gives, with the column passes for all texts but those that have to be walked.

    If not ``walked``, every text is plain: JSON is not parsed, and only what the passes put in the text is counted.
    """
    rows = df.select(id_col, col)
    walk = F.coalesce(F.col(col).rlike(WALKED), F.lit(False))
    plain = redacted(rows.filter(~walk) if walked else rows, col, ignore, "__redaction")
    plain = plain.select(F.col(id_col).alias("id"), F.col(col).alias("text"), "__redaction.*")
    return plain.unionByName(gated(rows.filter(walk), id_col, col, ignore)) if walked else plain
