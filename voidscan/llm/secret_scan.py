"""Secret scans: candidates by pattern, false positives removed by a random forest.  DataFrame operations only.

Candidates are what follows a word such as "password" and an equals sign or colon, long runs of letters and digits, and keys with a known
prefix inside either.  Values are whole, however long.  Features are SQL expressions of the candidate, the words around it and the path:

- its length and shares of kinds of characters
- its transitions: the mean log-likelihood of its letter pairs by the letter pairs of the corpus's words
- its coverage: how much of it are words of the corpus, which stand alone in at least `common` documents, and how much are words of code
- the words beside it, and the path

The corpus's words are counted in one pass and a shuffle of distinct words; pieces of candidates meet them by a join, so neither is ever gathered.
The forest is grown on the driver from a bounded table of labelled findings, and becomes one SQL expression.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voidscan.llm.frames import own, written

_NAME = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?|private[_-]?key)"
#: A named value, or a run of 16 characters at least with a digit.  Possessive quantifiers keep the scan linear.
CANDIDATE = _NAME + r"""["']?[ \t]{0,2}[:=][ \t]{0,2}["']?[^\s"',;]{6,}+|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+"""
#: Keys with a known prefix, after the start of a value.
INNER = r"(?<=.)(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[po]_[A-Za-z0-9]{20,}+|xox[bp]-[A-Za-z0-9-]{16,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{24,}+|eyJ[A-Za-z0-9_-]{16,}+)"
_SPLIT = "(?s)^" + _NAME + r"""["']?[ \t]{0,2}[:=][ \t]{0,2}["']?"""
# Words that ordinary identifiers, paths and prose are made of.
WORDS = ("about after again all and any app are array back base before between bool build button byte call can case char check class client code color "
         "column common config content context count create data date default delete demo dev doc double down each edit element empty end error even event "
         "example false field file find first float for form format from function get global group have header height hello home html http image index info "
         "input int item javascript join just key label last left length level line link list load local log long main make map max message method min mode "
         "model module more name new next node not note null number object off on one open option order other out over package page param parent part path "
         "plugin point position post print process property public query read ref remove report request reset result return right role root run sample save "
         "search section select self send server service session set short show side size some sort source start state static status step stop string style "
         "table tag target test text that the then this time title top total true type undefined update upload url use user util value var version view was "
         "when where which width will window with word world write your").split()
_LONG_WORDS = "|".join(sorted((w for w in WORDS if len(w) > 2), key=lambda w: (-len(w), w)))
FEATURES = ("chars", "digits", "uppers", "lowers", "signs", "changes", "distinct", "hex", "transitions", "covered", "listed", "vowels", "named", "harmless_near", "harmless_value", "path_value", "test_path",
            "known_prefix")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def _letter(c: Column) -> Column:
    """1 to 26 for a to z, 0 for any other character."""
    return F.when((c >= "a") & (c <= "z"), F.ascii(c) - 96).otherwise(0)


def corpus_words(docs: DataFrame, text_col: str, common: int) -> DataFrame:
    """(word, docs): words without digits, of 3 to 30 characters, that stand alone in at least `common` texts."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), r"[\s\p{Punct}]+"))).alias("word"))
    return words.where(F.length("word").between(3, 30) & ~F.col("word").rlike("[0-9]")).groupBy("word").agg(F.count("*").alias("docs")).where(F.col("docs") >= common)


def letter_pairs(words: DataFrame) -> list[float]:
    """Log-probabilities of a letter (or another character) after another, 27 by 27, over the words of a corpus; uniform without any."""
    codes = F.transform(F.split("word", ""), _letter)
    n = F.size(codes) - 1
    pairs = words.select("docs", F.explode(F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * 27 + b)).alias("pair"))
    count = np.ones(27 * 27)
    for r in pairs.groupBy("pair").agg(F.sum("docs").alias("n")).collect():  # 729 rows at most
        count[r["pair"]] += r["n"]
    table = count.reshape(27, 27)
    return np.log(table / table.sum(1, keepdims=True)).round(6).reshape(-1).tolist()


def coverage(values: DataFrame, words: DataFrame) -> DataFrame:
    """(value, covered): distinct values, and which share of each are words of the corpus."""
    every = values.select("value").distinct()
    piece = F.explode(F.split(F.lower(F.regexp_replace("value", "([a-z])([A-Z])", "$1 $2")), r"[^\p{L}]+"))
    met = every.select("value", piece.alias("word")).where(F.length("word") >= 3).join(words.select("word"), "word")
    known = met.groupBy("value").agg(F.sum(F.length("word")).alias("known"))
    return every.join(known, "value", "left").select("value", (F.coalesce("known", F.lit(0)) / F.greatest(F.length("value"), F.lit(1))).alias("covered"))


def features(pairs: list[float]) -> list[Column]:
    """FEATURES of rows (value, covered, before, after, path)."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    near = F.lower(F.concat_ws(" ", "before", "after"))
    low = F.lower(v)
    codes, steps = F.transform(F.split(low, ""), _letter), F.length("value") - 1
    table = _array(pairs, "double")
    likely = F.zip_with(F.slice(codes, F.lit(1), steps), F.slice(codes, F.lit(2), steps), lambda a, b: F.get(table, a * 27 + b))
    return [c.cast("double").alias("f_" + name) for name, c in zip(FEATURES, (
        n, _count(v, "[0-9]") / n, _count(v, "[A-Z]") / n, _count(v, "[a-z]") / n, _count(v, "[^A-Za-z0-9]") / n,
        _count(v, "[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])") / n,
        F.size(F.array_distinct(F.split(v, ""))) / n, v.rlike("^[0-9a-fA-F]+$").cast("int"),
        F.when(steps > 0, F.aggregate(likely, F.lit(0.0), lambda s, x: s + x) / steps).otherwise(0.0), F.col("covered"),
        1 - F.length(F.regexp_replace(low, _LONG_WORDS, "")) / n, _count(low, "[aeiou]") / n,
        F.col("before").rlike(_NAME).cast("int"),
        near.rlike(r"\b(?:commit|revision|sha[0-9]*|md5|checksum|digest|uuid|guid|etag|version|build|hash|serial|isbn|order|invoice)\b").cast("int"),
        low.rlike(r"example|sample|dummy|test|change_?me|placeholder|your|xxxx|1234567|abcdef|\*\*\*|<|\$|\{").cast("int"),
        v.rlike(r"/[A-Za-z0-9_-]+/|\.[a-z]{2,4}$|^https?:").cast("int"),
        F.lower(F.coalesce("path", F.lit(""))).rlike("test|example|sample|fixture|mock|docs?/").cast("int"),
        v.rlike("^(?:AKIA|ASIA|ghp_|gho_|xox[bp]-|sk_live_|AIza|eyJ)").cast("int")))]


def labelled_findings(spark: SparkSession, each: int = 40, seed: int = 5) -> DataFrame:
    """Findings (value, before, after, path, label) made by rule: kinds of values in kinds of surroundings, `each` of a pair.

    A random value is a secret under a credential's name or by itself, and none beside the name of a checksum or in a path of tests; a key with a
    known prefix is one anywhere but in tests; words, numbers, places, calls and placeholders never are, whatever stands before them.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    hexa, digits = list("0123456789abcdef"), list("0123456789")
    upper, lower = list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), list("abcdefghijklmnopqrstuvwxyz")
    every = [*lower, *upper[:26], *digits]
    draw = lambda letters, n: "".join(rng.choice(letters, n))
    word = lambda: str(rng.choice(WORDS)) if rng.random() < 0.5 else "".join(draw(list("bcdfglmnprst"), 1) + draw(list("aeiou"), 1) for _ in range(between(2, 4)))
    some = lambda *x: str(x[rng.integers(len(x))])
    between = lambda a, b: int(rng.integers(a, b))
    randoms = [
        lambda: draw(hexa, some_size(rng, 16, 18, 20, 24, 32, 40, 64)), lambda: draw(every, between(16, 64)) + some("", "", "="), lambda: draw(lower + digits, between(16, 40)),
        lambda: "-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12))]
    prefixed = [lambda: some("AKIA", "ASIA") + draw(upper, 16), lambda: some("ghp_", "sk_live_", "AIza", "xoxb-", "eyJ") + draw(every, between(24, 44))]
    phrases = [lambda: word().title() + draw(digits, between(2, 5)) + draw(list("!#%&"), 2) + word(), lambda: draw(every, between(8, 15)) + draw(digits, 1)]
    harmless = [
        lambda: "_".join(word() for _ in range(between(3, 6))) + draw(digits, 1), lambda: "/".join(word() for _ in range(between(3, 6))) + "/" + word() + draw(digits, 1),
        lambda: draw(digits, between(16, 20)), lambda: some("true", "None12", "string", "getToken()", "process.env.T1", "self.token", "required", "optional", "undefined") + some("", draw(digits, 2)),
        lambda: some("your_password_here", "changeme", "example-token-", "xxxxxxxxxxxxxxxx", "test_password_", "<password>", "${TOKEN}", "placeholder") + draw(digits, between(1, 8)),
        lambda: "20" + draw(digits, 2) + "-" + draw(list("01"), 2) + "-" + draw(list("012"), 2) + "T" + draw(list("012345"), 6) + "-build",
        lambda: word() + word().title() + word().title() + draw(digits, 1) + word().title()]
    names = lambda: some("password", "passwd", "pwd", "token", "secret", "auth", "api_key", "api-key", "credential", "access_key", "private_key") + some("=", " = ", ": ", ': "', '="')
    sums = lambda: some("commit", "sha256", "md5", "checksum", "digest", "revision", "etag", "uuid", "guid", "build", "version", "hash") + some(" ", ": ", " = ")
    plain = lambda: some("", word() + " ", "use ", "key id ", "bearer ", "see ", "the ")
    rows = []
    for makers, kind in ((randoms, "random"), (prefixed, "prefixed"), (phrases, "phrase"), (harmless, "harmless")):
        for make in makers:
            for around in (names, sums, plain):
                if kind == "phrase" and around is not names:
                    continue  # a short value without a name is no candidate
                for _ in range(each):
                    tests = rng.random() < 0.25
                    label = kind != "harmless" and not (tests and around is not names) and (around is not sums or kind == "prefixed")
                    if make is randoms[3] and around is not names:
                        label = False
                    path = some("tests/unit", "docs/readme", "examples/a", "fixtures") if tests else some("src", "lib/main", "app", "web", f"src{between(0, 30)}")
                    rows.append((make(), f"{word()} {around()}", some("", " " + word(), ".", '"'), path, int(label)))
    return spark.createDataFrame(rows, "value string, before string, after string, path string, label int")


def some_size(rng: np.random.Generator, *sizes: int) -> int:
    return int(sizes[rng.integers(len(sizes))])


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int):
    """A tree: a share of secrets, or (feature, threshold, tree up to it, tree above)."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = (1e9, 0, 0.0)
    for f in rng.choice(x.shape[1], int(np.ceil(np.sqrt(x.shape[1]))), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= least) & (cut <= len(y) - least)]
        if not len(cut):
            continue
        a, b = ones[cut - 1], ones[-1] - ones[cut - 1]
        gini = a * (1 - a / cut) + b * (1 - b / (len(y) - cut))
        k = int(gini.argmin())
        if gini[k] < best[0]:
            best = (float(gini[k]), int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2))
    if best[0] > 1e8:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], y[low], rng, depth - 1, least), _grow(x[~low], y[~low], rng, depth - 1, least)


def _array(values: list, kind: str) -> Column:
    """A literal array; it is read once, when the plan is made."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _flat(tree, nodes: list) -> int:
    """Put a tree into a list of (feature, threshold, below, above, share), and give its root's place; a leaf leads to itself."""
    at = len(nodes)
    nodes.append(None)
    if isinstance(tree, float):
        nodes[at] = (0, 0.0, at, at, tree)
    else:
        nodes[at] = (tree[0], tree[1], _flat(tree[2], nodes), _flat(tree[3], nodes), 0.0)
    return at


def bounded(findings: DataFrame, most: int = 20_000) -> DataFrame:
    """`most` findings at most, chosen by their hash."""
    return findings.where(F.col("label").isin(0, 1) & F.col("value").isNotNull()).orderBy(F.xxhash64("value", "before", "after", "path", "label")).limit(most)


def forest(findings: DataFrame, pairs: list[float], trees: int = 25, depth: int = 8, least: int = 4, seed: int = 3) -> Column:
    """The share of secrets that a random forest predicts from the feature columns.  Its trees are literal arrays, walked by `depth` steps each.

    findings: a bounded table (value, covered, before, after, path, label).  Without findings of both labels it keeps every candidate.
    """
    rows = findings.orderBy("value", "before", "after", "path", "label").select("label", *features(pairs)).collect()
    data = np.array([tuple(r) for r in rows], float).reshape(len(rows), 1 + len(FEATURES))
    y, x = data[:, 0], data[:, 1:]
    if len(set(y)) < 2:
        return F.lit(1.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    nodes: list = []
    roots = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        roots.append(_flat(_grow(x[pick], y[pick], rng, depth, least), nodes))
    feature, threshold, below, above, share = (_array(list(c), k) for c, k in zip(zip(*nodes), ("int", "double", "int", "int", "double")))

    def share_of(values: Column) -> Column:
        step = lambda at, _: F.when(F.get(values, F.get(feature, at)) <= F.get(threshold, at), F.get(below, at)).otherwise(F.get(above, at))
        leaf = lambda root: F.get(share, F.aggregate(_array(list(range(depth)), "int"), root, step))
        return F.aggregate(_array(roots, "int"), F.lit(0.0), lambda total, root: total + leaf(root)) / trees

    # the features are bound once: inside the walk each use of a column would compute it anew
    return F.get(F.transform(F.array(F.array(*[F.col("f_" + f) for f in FEATURES])), share_of), F.lit(0))


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(id, line, nth, value, before, after, path): every candidate with up to 48 and 24 characters around it in its line."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    some = docs.select(F.col(id_col).alias("__id"), path.alias("path"), F.col(text_col).alias("__text")).where(F.col("__text").rlike(CANDIDATE))
    line = some.select("__id", "path", F.posexplode(F.split("__text", "\n")).alias("line", "__line")).where(F.col("__line").rlike(CANDIDATE))
    inner = lambda x: F.regexp_extract_all(F.regexp_replace(x, _SPLIT, ""), F.lit(INNER), F.lit(0))
    every = F.flatten(F.transform(F.regexp_extract_all("__line", F.lit(CANDIDATE), F.lit(0)), lambda x: F.concat(F.array(x), inner(x))))
    found = line.select("__id", "path", "line", "__line", F.posexplode(every).alias("nth", "__found"))
    at = F.instr("__line", F.col("__found"))
    name = F.regexp_extract("__found", _SPLIT, 0)
    return found.select(
        "__id", "path", F.col("line").cast("long").alias("line"), F.col("nth").cast("long").alias("nth"), F.substr("__found", F.length(name) + 1).alias("value"),
        F.concat(F.substring("__line", F.greatest(F.lit(1), at - 48), F.least(F.lit(48), at - 1)), name).alias("before"),
        F.substring("__line", at + F.length("__found"), F.lit(24)).alias("after"))


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, common: int = 3) -> DataFrame:
    """(id, line, nth, kind, value, n_chars, score, is_secret): a row for each candidate of each text.

    findings: labelled findings (value, before, after, path, label) to learn from, of which 20,000 by hash are used; made by rule without any.
    line counts from 0, nth from 0 within the line; keys inside a value follow it.  A value that a line holds twice has the surroundings of
    its first place.  A null or empty text has no candidates; a null path is no path; a null id stays null; repeated rows give their findings
    each, and count as texts of their own for the corpus's words.  An empty table gives no rows.  Other columns are not used.
    """
    spark = docs.sparkSession
    findings = bounded(labelled_findings(spark) if findings is None else findings)
    found = written(candidates(docs, id_col, text_col, path_col))
    words = written(corpus_words(docs, text_col, common))
    pairs = letter_pairs(words)
    known = written(coverage(found.select("value").unionByName(findings.select("value")), words))
    tree = forest(findings.join(known, "value"), pairs)
    kind = (F.when(F.col("value").startswith("AKIA"), "key_id").when(F.col("before").rlike(_NAME + r"""["']?[ \t]{0,2}[:=][ \t]{0,2}["']?$"""), "named_value").otherwise("run"))
    scored = found.join(known, "value").select("*", kind.alias("kind"), *features(pairs)).withColumn("score", tree)
    return own(scored, id_col).select(F.col("__id").alias(id_col), "line", "nth", "kind", "value", F.length("value").cast("long").alias("n_chars"), "score", (F.col("score") >= threshold).alias("is_secret"))
