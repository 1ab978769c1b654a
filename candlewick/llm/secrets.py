"""Secret scan: candidates by pattern, false positives removed by a random forest, all in DataFrame expressions.

The forest is trained by Spark's DataFrame-based random forest on labelled findings and turned into one expression
of nested comparisons. Candidates are kept in an array beside their text, so that scanning and redacting need no
shuffle, and whole texts are read where they lie.
"""

from __future__ import annotations

import json
import random
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind

#: Names that assign secrets, prefixes of public key formats, and short English words and pieces.
_NAMES = r"token|secret|passw(?:or)?d|passwd|pwd|passphrase|api[_-]?key|access[_-]?key(?:[_-]?id)?|(?:private|secret|signing|encryption|master|account|ssh)[_-]?key|client[_-]?secret|credentials?|bearer|auth"
ASSIGN = rf"(?i:(?:{_NAMES})(?:[\"']?[ \t]*(?::=|=>|[:=])[ \t]*[\"']?|[ ][ \t]{{0,3}}[\"']?))"
PREFIXES = r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|eyJ|SG\.|npm_|ya29\."
_RUN = r"[A-Za-z0-9+/_=.~!@#$%^&*-]"
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,\\-]*?-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
    rf"|(?i:{_NAMES})[\"']?[ \t]*(?::=|=>|[:=])[ \t]*[\"']?{_RUN}{{6,}}"
    rf"|(?<![A-Za-z0-9]){ASSIGN}{_RUN}{{6,}}"
    r"|(?<=://)[^\s:/@\"'<>]{1,64}:[^\s:/@\"'<>]{3,}(?=@)"
    rf"|(?<![A-Za-z0-9+/_=-])(?:{PREFIXES})[A-Za-z0-9+/_=.-]{{12,}}"
    rf"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{{16,}}"
)
#: What a hit begins with that is not its value: the name that assigns it, or the user of a URL.
_HEAD = rf"^(?:{ASSIGN}|[^\s:/@]{{1,64}}:(?=[^\s:/@]{{3,}}$))"
DICTIONARY = (
    "about access account admin after agent also answer api app array auth back base before block body build button cache call change check class client code "
    "column common config connect content count create current data date default delete demo dev device domain download dummy edit email enable end error event "
    "example false field file filter first folder form format from function global group header hello home host http image import index info input insert item "
    "java json key label last layer level library license line link list local lock login main manager map message method mode model module name network next "
    "node null number object option order output package page param parent pass password path place plain point port print private process product project public "
    "query read record report request reset response result root sample save schema script search secret section select server service session setting size source "
    "start state status string style submit super system table target template test text thread time title token total true type unit update upload url user util "
    "value version video view wait web window with word work world write your"
).split()
BIGRAMS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt de le la que ch ei un se ra ie me ou ur ro li io co".split()
#: Code points of context on either side of a candidate.
CONTEXT = 48
FEATURES = 19


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """FEATURES doubles: length, character transitions, dictionary coverage, path and neighbouring words."""
    n = F.greatest(F.char_length(value), F.lit(1)).cast("double")
    low = F.lower(value)
    shares = bind(F.split(value, ""), lambda signs: F.transform(F.array_distinct(signs), lambda c: F.size(F.filter(signs, lambda x: x == c)) / n))
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    flag = lambda col, pattern: col.rlike(pattern).cast("double")
    return [
        F.least(n, F.lit(400.0)),
        entropy,
        _count(value, "[0-9]") / n,
        _count(value, "[A-Z]") / n,
        _count(value, r"[^A-Za-z0-9]") / n,
        flag(value, r"^[0-9a-fA-F]+$"),
        flag(value, r"^[0-9 ._-]+$"),
        _count(value, r"(?=[a-z][^a-z]|[A-Z][^A-Z]|[0-9][^0-9])") / n,
        _count(low, rf"(?={'|'.join(BIGRAMS)})") / n,
        _count(low, r"(?=[bcdfghjklmnpqrstvwxz]{3})") / n,
        F.lit(1.0) - F.char_length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / n,
        flag(value, rf"^(?:{PREFIXES})"),
        flag(low, r"example|your|change|dummy|xxxx|placeholder|<|\*\*\*|0000|1234|none|null|todo|\$\{"),
        flag(low, r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        flag(before, r"(?i)(?:token|secret|passw|pwd|key|credential|bearer|auth)[a-z_\"' ]{0,12}[:=> ]{1,4}[\"']?$"),
        flag(before, r"(?i)commit|sha-?\d|md5|hash|digest|checksum|revision|etag|uuid|order|invoice|card|isbn|phone|build|version"),
        flag(before, r"[\"'=:]\s?$"),
        flag(after, r"^[\"';,)\n]"),
        flag(F.coalesce(path, F.lit("")), r"(?i)test|spec|example|sample|fixture|mock|docs?/|readme|vendor|\.lock"),
    ]


def _running(lengths: Column) -> Column:
    """array<long>: what comes before each of some lengths, by blocks of 256, so that no long array is grown one by one."""
    nothing = F.array().cast("array<long>")
    added = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    begin = lambda at: F.struct(at.cast("long").alias("at"), nothing.alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 256).cast("int")), lambda i: F.slice(lengths, i * 256 + 1, 256))

    def placed(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, n: a + n))
        return bind(F.aggregate(sums, begin(F.lit(0)), added, lambda a: a["out"]), lambda offsets: F.flatten(F.zip_with(parts, offsets, lambda p, o: F.aggregate(p, begin(o), added, lambda a: a["out"]))))

    return F.when(F.size(lengths) == 0, nothing).otherwise(bind(blocks, placed))


def _parts(text: Column) -> Column:
    """array<struct<gap, head, value>> of a whole text: what comes before each hit, what assigns it, and the hit's value; then the rest as a last gap."""
    gaps, hits = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))

    def one(gap, hit):
        value = F.regexp_replace(F.coalesce(hit, F.lit("")), _HEAD, "")
        value = F.when(value == "", hit).otherwise(value)
        return F.struct(gap.alias("gap"), F.left(hit, F.char_length(hit) - F.char_length(value)).alias("head"), value.alias("value"))

    return F.zip_with(gaps, hits, one)


def candidates(parts: Column) -> Column:
    """array<struct<start, value, before, after>> of _parts(): start in code points; before and after reach into the neighbouring gap and hit, CONTEXT signs at most."""
    n = F.size(parts) - 1
    size = lambda p: F.char_length(p["gap"]).cast("long") + F.coalesce(F.char_length(p["head"]) + F.char_length(p["value"]), F.lit(0))
    told = lambda p: F.concat(p["gap"], F.coalesce(p["head"], F.lit("")), F.coalesce(p["value"], F.lit("")))

    def one(p, i, starts):
        earlier = F.when(i > 0, F.right(told(F.get(parts, i - 1)), F.lit(CONTEXT))).otherwise("")
        return F.struct(
            (F.get(starts, i) + F.char_length(p["gap"]) + F.char_length(p["head"])).alias("start"),
            p["value"].alias("value"),
            F.right(F.concat(earlier, p["gap"], p["head"]), F.lit(CONTEXT)).alias("before"),
            F.left(told(F.get(parts, i + 1)), F.lit(CONTEXT)).alias("after"),
        )

    return bind(_running(F.transform(parts, size)), lambda starts: F.transform(F.slice(parts, 1, n), lambda p, i: one(p, i, starts)))


def labelled_findings(rows: int = 1600, seed: int = 17) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label) made by rule: keys of public formats and random strings against hashes, numbers, names and placeholders.

    Stands in where no reviewed findings are given; ``rows`` bounds the training data.
    """
    rng = random.Random(seed)
    pick = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    hexa, word, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    prose = ["the value of ", "and then ", "of the ", "was found near ", "que la ", "die der ", "les de ", ""]
    keyed = ['token = "', "token: ", 'api_key = "', "API_KEY=", 'secret: "', "client_secret=", "password = '", 'password: "', "pwd=", "aws_secret_access_key = ", "Authorization: Bearer ", 'access_key = "']
    hashed = ["commit ", "sha1: ", "sha256:", "md5 = ", "checksum ", "revision=", 'etag: "', "digest ", "build ", "uuid ", "order ", "card ", "invoice no. "]
    ends = ['"', "'", " and", "\n", ";", " the", ".", '" en', ",", ""]
    clean, tests = ["src/app.py", "config/prod.yml", "lib", "notes.txt", "data", "web"], ["tests/unit.py", "docs/guide.md", "README", "examples/a.js", "fixtures/x", "yarn.lock"]
    syllables = ["the", "ing", "tion", "er", "an", "ou", "ment", "re", "lich", "keit", "os", "que", "es", "ver", "able", "user", "data", "view"]
    out = []
    for i in range(rows):
        if i % 2:
            value = rng.choice([
                lambda: pick(hexa, rng.choice([32, 40, 40, 48, 64])), lambda: pick(word, rng.randint(16, 48)), lambda: pick(b64, 40), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
                lambda: rng.choice(["ghp_", "sk_live_", "glpat-", "npm_", "AIza"]) + pick(word, 36), lambda: "eyJ" + pick(word, 60) + "." + pick(word, 80), lambda: pick(word + "!@#$%^&*", rng.randint(9, 20)),
                lambda: "-----BEGIN RSA PRIVATE KEY-----",
            ])()
            loose = value.startswith(("AKIA", "ghp_", "sk_live", "glpat", "npm_", "AIza", "eyJ", "-----"))
            before = rng.choice(keyed) if not loose or rng.random() < 0.6 else rng.choice(prose)
            out.append((value, rng.choice(prose) + before, rng.choice(ends), rng.choice(clean if rng.random() < 0.9 else tests), 1))
        else:
            kind = rng.randrange(8)
            if kind < 2:
                value, before = pick(hexa, rng.choice([32, 40, 64])), rng.choice(hashed[:9] + prose)
            elif kind == 2:
                value, before = pick(string.digits, rng.choice([15, 16, 16, 18, 20])), rng.choice(hashed[-4:] + prose * 3)
            elif kind == 3:
                value, before = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), rng.choice(hashed + prose)
            elif kind == 4:
                value, before = rng.choice(["your-token-here", "changeme", "example_key_1234567890", "xxxxxxxxxxxxxxxxxxxx", "${SECRET_TOKEN}", "dummy-password", "test1234", "<token>", "REPLACE_ME_0000", "none"]), rng.choice(keyed)
            elif kind == 5:
                value, before = "".join(rng.choice(syllables) for _ in range(rng.randint(2, 6))), rng.choice(keyed + ["token ", "secret ", "auth ", "password "] * 4)
            elif kind == 6:
                value, before = rng.choice(["/", "_", "-"]).join("".join(rng.choice(syllables) for _ in range(2)) for _ in range(3)) + str(rng.randint(0, 2024)), rng.choice(prose)
            else:
                value, before = pick(word, rng.randint(18, 60)), rng.choice(["image/png;base64,", "integrity=sha384-", "?page=2&ref=", "digest ", "hash "])
            out.append((value, rng.choice(prose) + before, rng.choice(ends), rng.choice(clean if rng.random() < 0.7 else tests), 0))
    return out


def train_forest(findings: DataFrame, trees: int = 25, depth: int = 6, seed: int = 5) -> list:
    """The trees of a random forest over ``findings`` (value, before, after, path, label): nested (feature, threshold, low, high), or the chance of a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = findings.select(array_to_vector(F.array(*features(F.col("value"), F.col("before"), F.col("after"), F.col("path")))).alias("features"), F.col("label").cast("double").alias("label")).cache()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    rows.unpersist()

    def grown(node):
        if node.numDescendants() == 0:
            counts = list(node.impurityStats().stats())
            return float(counts[1]) / max(sum(counts), 1e-12)
        split = node.split()
        return (split.featureIndex(), float(split.threshold()), grown(node.leftChild()), grown(node.rightChild()))

    return [grown(t._java_obj.rootNode()) for t in model.trees]


_forests: dict[tuple, list] = {}


def default_forest(spark: SparkSession, rows: int = 1600, seed: int = 17) -> list:
    """The forest of labelled_findings(), trained once for a driver process."""
    if (rows, seed) not in _forests:
        # one literal, so that the training data come from no Python worker
        names = ("value", "before", "after", "path", "label")
        made = json.dumps([dict(zip(names, r, strict=True)) for r in labelled_findings(rows, seed)])
        kind = "array<struct<value:string,before:string,after:string,path:string,label:int>>"
        _forests[rows, seed] = train_forest(spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(made), kind))))
    return _forests[rows, seed]


def forest_score(forest: list, found: Column) -> Column:
    """Mean chance of a secret over the trees; found: array of features."""

    def grown(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        feature, threshold, low, high = tree
        return F.when(found[feature] <= threshold, grown(low)).otherwise(grown(high))

    return sum((grown(t) for t in forest[1:]), grown(forest[0])) / len(forest)


def _judged(parts: Column, path: Column, forest: list, threshold: float) -> Column:
    """array<struct<start, value, score, is_secret>> of the candidates of _parts()."""
    made = F.transform(candidates(parts), lambda c: F.struct(c["start"].alias("start"), c["value"].alias("value"), F.array(*features(c["value"], c["before"], c["after"], path)).alias("x")))
    scored = F.transform(made, lambda c: F.struct(c["start"].alias("start"), c["value"].alias("value"), forest_score(forest, c["x"]).alias("score")))
    return F.transform(scored, lambda c: F.struct(c["start"], c["value"], c["score"], (c["score"] >= threshold).alias("is_secret")))


def findings(text: Column, path: Column, forest: list, threshold: float = 0.5) -> Column:
    """array<struct<start, value, score, is_secret>> of all candidates of a whole text, in its order."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:bigint,value:string,score:double,is_secret:boolean>>")
    return F.when(text.rlike(CANDIDATE), bind(_parts(text), lambda parts: _judged(parts, path, forest, threshold))).otherwise(none)


def scan(docs: DataFrame, forest: list | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, start (code points from 0), value, score (0 to 1), is_secret (score at least ``threshold``).

    ``forest`` comes from train_forest() over reviewed findings; by default from labelled_findings(). Null and empty
    texts hold no candidate; a null path is an empty one; repeated rows give their findings each; null ids stay null.
    An empty table gives no rows; other columns are not read.
    """
    forest = forest or default_forest(docs.sparkSession)
    path = F.col(path_col) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), findings(F.col(text_col), path, forest, threshold).alias("all"))
    return rows.select("doc_id", F.explode("all").alias("f")).select("doc_id", "f.*")


def redact(docs: DataFrame, forest: list | None = None, threshold: float = 0.5, mark: str = "[SECRET]", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """All rows and columns, with ``mark`` in place of every secret; texts without one are left as they are (null stays null)."""
    forest = forest or default_forest(docs.sparkSession)
    path = F.col(path_col) if path_col else F.lit("")
    text = F.col(text_col)

    def rebuilt(parts: Column) -> Column:
        put = lambda p, f: F.concat(p["gap"], F.coalesce(p["head"], F.lit("")), F.when(f["is_secret"], F.lit(mark)).otherwise(F.coalesce(p["value"], F.lit(""))))
        return bind(_judged(parts, path, forest, threshold), lambda found: F.when(F.exists(found, lambda f: f["is_secret"]), F.array_join(F.zip_with(parts, found, put), "")).otherwise(text))

    cut = F.when(text.rlike(CANDIDATE), bind(_parts(text), rebuilt)).otherwise(text)
    return docs.select(*[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
