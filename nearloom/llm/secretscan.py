"""Secret scans: key-like runs and assigned values, and a random forest that drops false positives.

A candidate is a run of at least 16 of ``A-Za-z0-9+/_=-``, or whatever stands, without white space
or quotes, where a value of at least 6 characters is assigned to a name that speaks of a secret.
What the forest sees of it: length, shares of character kinds, transitions between them, distinct
characters, coverage by dictionary words, the words and signs beside it, and the path of its
source.  The forest is trained in numpy on labelled findings and becomes one SQL expression, so
scanning uses built-in functions only: no Python on the executors, one pass, no shuffle.

``labelled_findings`` makes a bounded set of findings, as the tables have none; ``fit`` takes real
ones instead.

Defined results: null and empty texts have no candidates; a null path counts as empty; every row
gives one row, repeated or not; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMED = r"(?:token|secret|passwo?r?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credentials?|signing[_ -]?key)"
_ASSIGNED = r"(?:=>|:=|[=:])\s{0,3}[\"'`]?"
#: A long run; or, behind an assignment (looked for first, as it is cheap) to a telling name, any value.
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{16,}}|(?<=[=:>]\s{{0,3}}[\"'`]?)(?<=(?i:{_NAMED})[\"'`]?\s{{0,3}}{_ASSIGNED})[^\s\"'`=:>][^\s\"'`]{{5,}}"
BESIDE = 48
THRESHOLD = 0.5
TREES, DEPTH, FINDINGS = 15, 7, 6000

_WORDS = "about|after|again|also|address|and|app|auth|back|base|before|book|build|call|card|city|class|client|code|color|com|commit|config|count|country|create|data|date|default|document|east|end|error|event|example|file|first|for|from|function|get|group|have|header|high|home|house|http|image|index|info|input|item|key|last|line|link|list|local|long|main|make|many|message|method|name|new|north|number|object|order|page|part|path|people|phone|place|point|post|private|product|project|public|read|release|report|request|response|result|road|route|sample|school|search|server|service|set|small|some|south|state|street|string|system|table|test|text|that|the|this|time|title|token|type|update|user|value|version|view|water|week|west|with|word|work|world|www|year|your"
_SECRET = r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|api[_ -]?key|apikey|access[_ -]?key|auth|bearer|credential|private[_ -]?key|signing)[A-Za-z_ -]{0,12}[\"'`]?\s*(?:[=:]|=>|:=|is)?\s*[\"'`]?$"
_INNOCENT = r"(?i)(?:commit|sha-?\d*|md5|checksum|digest|etag|uuid|guid|isbn|issn|card|phone|tel|fax|iban|account|order|invoice|tracking|example|sample|placeholder|dummy|rev|revision|version|parent|tree|blob)\W{0,6}$"
_TEST_PATH = r"(?i)(?:^|[/_.-])(?:tests?|examples?|samples?|fixtures?|mocks?|docs?)(?:[/_.-]|$)"

NAMES = ("length", "digits", "lower", "upper", "signs", "hex", "transitions", "distinct", "vowel_pairs", "dictionary", "secret_word", "innocent_word", "assigned", "quoted", "repeats", "test_path", "other")


def features(run: Column, left: Column, right: Column, path: Column) -> list[Column]:
    """In the order of ``NAMES``, all doubles."""
    n = F.char_length(run)
    share = lambda keep: F.char_length(F.regexp_replace(run, f"[^{keep}]", "")) / n
    pairs = lambda pattern: F.size(F.regexp_extract_all(run, F.lit(pattern), F.lit(0))) / n
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return [
        F.least(n, F.lit(200)).cast("double"),
        share("0-9"),
        share("a-z"),
        share("A-Z"),
        share("+/_=-"),
        share("0-9a-fA-F"),
        pairs("[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]|[A-Z][a-z]"),
        F.size(F.array_distinct(F.split(run, ""))) / F.least(n, F.lit(64)),
        pairs("(?i)[bcdfghjklmnpqrstvwxz][aeiou]"),
        1 - F.char_length(F.regexp_replace(F.lower(run), _WORDS, "")) / n,
        flag(left.rlike(_SECRET)),
        flag(left.rlike(_INNOCENT)),
        flag(left.rlike(r"(?:[=:]|=>|:=)\s*[\"'`]?$")),
        flag(left.rlike(r"[\"'`]$") & right.rlike(r"^[\"'`]")),
        pairs(r"(.)\1"),
        flag(path.rlike(_TEST_PATH)),
        F.char_length(F.regexp_replace(run, "[A-Za-z0-9+/_=-]", "")) / n,
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 11, kinds: list | None = None) -> list[tuple[str, str, str, str, int]]:
    """(run, left, right, path, label): made-up keys, and what is often taken for them; ``kinds`` gets their names."""
    g = np.random.default_rng(seed)
    pick = lambda of: of[int(g.integers(len(of)))]
    chars = lambda of, k: "".join(pick(of) for _ in range(k))
    some = lambda a, b: int(g.integers(a, b))
    words = [w for w in _WORDS.split("|") if len(w) > 2]
    hexes, letters, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    both, base = letters + letters.upper(), letters + letters.upper() + digits
    syllable = lambda: pick("bcdfghklmnprst") + pick("aeiou") + pick(["", "", "n", "r", "s"])
    prose = lambda: " ".join("".join(syllable() for _ in range(some(1, 5))) for _ in range(4)) + " "
    keys = {
        "hex": lambda: chars(hexes, pick([32, 40, 64])),
        "upper hex": lambda: chars(hexes, pick([32, 40])).upper(),
        "mixed": lambda: chars(base, some(20, 64)),
        "base64": lambda: chars(base + "+/", pick([40, 44, 88])) + pick(["", "=", "=="]),
        "prefixed": lambda: pick(["key_", "sk_", "pat-", "ghx_"]) + chars(base, some(20, 40)),
        "letters only": lambda: chars(both, some(16, 48)),
        "short password": lambda: "".join(g.permutation(list(pick(digits) + pick("!@#$%&*?^~+.,;") + pick(letters.upper()) + chars(base + "!@#$%&*?", some(5, 12))))),
    }
    names = ["token", "secret", "password", "api_key", "API-KEY", "auth", "access_key", "private_key", "TOKEN", "client_secret", "db_password", "pwd"]
    plain = ["required", "undefined", "username", "disabled", "optional", "function", "changeme", "password", "refresh_token", "getToken()", "os.environ", "process.env.TOKEN", "${SECRET}", "<your-token>", "********", "settings.AUTH", "boolean", "string;", "null);", "request.user"]
    others = {
        "number": lambda: (pick(["", "card ", "order ", "tel: ", "account: "]), chars(digits, some(16, 20))),
        "checksum": lambda: (pick(["commit ", "sha256: ", "md5 = ", "checksum: ", 'etag: "', "revision "]), chars(hexes, pick([40, 64, 32]))),
        "slug": lambda: ("", pick(["-", "_", "/"]).join([pick(words) for _ in range(some(3, 6))] + [chars(digits, some(1, 5))])),
        "uuid": lambda: (pick(["uuid ", "id: ", ""]), "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12))),
        "word": lambda: ("", "".join(syllable() for _ in range(some(8, 14))) + pick(["", "", chars(digits, some(1, 3))])),
        "filler": lambda: (pick(['token = "', "password: ", "api_key=", ""]), pick(["x", "X", "0", "1", "a", "="]) * some(16, 60) + pick(["", "1"])),
        "time": lambda: ("", f"{some(1990, 2030)}-{some(1, 13):02d}-{some(1, 29):02d}" + pick(["T", "_", "-"]) + chars(digits, 6)),
        "path": lambda: (pick(['path = "', "url: ", ""]), "/".join([pick(words) for _ in range(4)]) + f"/v{some(1, 9)}/" + pick(words)),
        "placeholder": lambda: (pick(['token = "', 'secret: "', "api_key="]), "your_" + pick(["token", "secret", "api_key", "password"]) + pick(["_here_", "_example_", "_goes_here_"]) + pick(["", chars(digits, 2)])),
        "plain value": lambda: (pick(names) + pick([" = ", "=", ": "]), pick([lambda: pick(plain), lambda: pick(words) + pick(words), lambda: "".join(syllable() for _ in range(some(3, 6)))])()),
    }
    out = []
    for i in range(n):
        left, right, path, label = prose(), " " + prose(), f"src{some(0, 40)}", int(i % 2 == 0)
        kind = pick(list(keys if label else others))
        if label:
            run, quote, short = keys[kind](), pick(['"', "'", "", '"']), kind == "short password"
            left += pick(names if short else [*names, "Bearer"]) + pick([" = ", "=", ": ", ":="] if short else [" = ", "=", ": ", " := ", " "]) + quote
            right = quote + right
        else:
            before, run = others[kind]()
            left += before
            right = before[-1] + right if before[-1:] in ("\"", "'") else right
            path = pick([path, "docs/readme", "tests/fixtures"]) if kind == "placeholder" else path
        if kinds is not None:
            kinds.append(kind)
        out.append((run, left[-BESIDE:], right[:BESIDE], path, label))
    return out


def _tree(x: np.ndarray, y: np.ndarray, g: np.random.Generator, depth: int) -> tuple | float:
    if depth == 0 or len(y) < 10 or y.min() == y.max():
        return float(y.mean())
    best = None
    for j in g.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, c = x[order, j], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            n, k = len(y), cut + 1
            a, b = c[cut] / k, (c[-1] - c[cut]) / (n - k)
            cost = k * a * (1 - a) + (n - k) * b * (1 - b)
            i = int(np.argmin(cost))
            if best is None or cost[i] < best[0]:
                best = (cost[i], int(j), float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if best is None:
        return float(y.mean())
    _, j, at = best
    low = x[:, j] <= at
    return j, at, _tree(x[low], y[low], g, depth - 1), _tree(x[~low], y[~low], g, depth - 1)


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list:
    """A random forest: bootstrap samples, some features at each split, leaves hold shares."""
    g, out = np.random.default_rng(seed), []
    for _ in range(trees):
        rows = g.integers(0, len(y), len(y))
        out.append(_tree(x[rows], y[rows], g, depth))
    return out


def as_column(forest: list, of) -> Column:
    """The mean of the trees' shares, as nested CASE expressions; ``of(name)`` is a feature."""

    def one(t) -> Column:
        if isinstance(t, float):
            return F.lit(t)
        j, at, low, high = t
        return F.when(of(NAMES[j]) <= F.lit(at), one(low)).otherwise(one(high))

    total = one(forest[0])
    for t in forest[1:]:
        total = total + one(t)
    return total / F.lit(float(len(forest)))


def fit(spark: SparkSession, findings: list | None = None) -> list:
    """Trained on the features that scanning computes, of at most ``len(findings)`` rows."""
    rows = spark.createDataFrame(findings or labelled_findings(), "run string, l string, r string, path string, label int")
    named = [c.alias(n) for c, n in zip(features(F.col("run"), F.col("l"), F.col("r"), F.col("path")), NAMES, strict=True)]
    got = rows.select(*named, "label").collect()
    data = np.array([tuple(r) for r in got], float)
    return train(data[:, :-1], data[:, -1])


def scan(docs: DataFrame, forest: list, path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """For each row of ``docs``: how many candidates, and the findings as (start, length, score)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    path = F.coalesce(F.col(path_col), F.lit("")) if path_col else F.lit("")
    cut = docs.select("doc_id", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("runs"), F.split(text, CANDIDATE).alias("between"), path.alias("path"))
    each = F.when(F.size("runs") > 0, F.sequence(F.lit(0), F.size("runs") - 1)).otherwise(F.array().cast("array<int>"))

    def described(i: Column) -> Column:
        run, left, right = F.get("runs", i), F.substring(F.get("between", i), -BESIDE, BESIDE), F.substring(F.get("between", i + 1), 1, BESIDE)
        return F.struct(i.alias("i"), F.char_length(run).alias("length"), *[c.alias(n) for c, n in zip(features(run, left, right, F.col("path")), [f"f_{n}" for n in NAMES], strict=True)])

    known = cut.withColumn("described", F.transform(each, described))
    scored = known.withColumn("scored", F.transform("described", lambda d: F.struct(d["i"].alias("i"), d["length"].alias("length"), as_column(forest, lambda n: d[f"f_{n}"]).alias("score"))))
    kept = scored.withColumn("kept", F.filter("scored", lambda s: s["score"] >= threshold))
    chars = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda n, x: n + F.char_length(x))
    start = lambda s: chars(F.slice("between", F.lit(1), s["i"] + 1)) + F.when(s["i"] > 0, chars(F.slice("runs", F.lit(1), s["i"]))).otherwise(F.lit(0))
    found = F.transform("kept", lambda s: F.struct(start(s).alias("start"), s["length"].cast("long").alias("length"), s["score"].alias("score")))
    return kept.select("doc_id", F.size("runs").cast("long").alias("n_candidates"), F.size("kept").cast("long").alias("n_findings"), found.alias("findings"))
