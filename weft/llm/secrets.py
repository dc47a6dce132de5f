"""Secret scans: candidate patterns, then a random forest that removes false positives. DataFrame functions only."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import free, whole_text

#: Characters before a candidate that count as its neighbourhood.
BEFORE = 64
#: Candidates: what is assigned to a name that ends as a secret's (DB_PASSWORD, client_secret, quoted or not), of 8 characters
#: or more up to space or punctuation; and 16 or more token characters in a run with a digit, its whole run, however long.
#: A text is read once from left to right; the group is the value of an assignment.
TOKEN = r"[A-Za-z0-9_+/\-]"
NAMED = rf"(?<!{TOKEN}){TOKEN}*?(?i:password|passwd|pwd|secret|token|(?:api|access|secret|private)[_\-]?key)[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?([^\s\"'<>,;]{{7,}}[^\s\"'<>,;.!?)])"
RUN = rf"(?<!{TOKEN})(?=[A-Za-z_+/\-]*+[0-9]){TOKEN}{{16,}}+={{0,2}}"
CANDIDATE = f"{NAMED}|{RUN}"
#: Numbers summed up at once, so that sums of many places in a text cost little more than one by one.
RUNNING = 128
#: The last two words before a candidate.
NEAR = r"(?:[a-z0-9_\-]+[^a-z0-9_\-]+)?[a-z0-9_\-]*[^a-z0-9_\-]*$"
TREES, DEPTH, SEED = 9, 5, 11
#: Labelled findings that the forest is fitted on: this many, half of them secrets. A bound, whatever the corpus.
FINDINGS = 10_000
MASK = "[SECRET]"

# Words near secrets, words near harmless codes, prefixes of issued keys, and common word parts.
KEYWORDS = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private", "client_secret", "session", "key"]
HARMLESS = ["commit", "sha256", "sha1", "md5", "checksum", "digest", "revision", "rev", "build", "hash", "etag", "version", "uuid", "example", "sample", "order", "invoice", "isbn", "doi", "page", "id"]
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk_live_", "sk-", "xoxb-", "xoxp-", "glpat-", "AIza", "npm_", "eyJ"]
WORD_PARTS = [
    "example", "sample", "test", "your", "insert", "here", "change", "dummy", "placeholder", "password", "secret", "token", "key", "user", "name", "file",
    "page", "index", "image", "data", "docs", "article", "chapter", "version", "release", "build", "tion", "ing", "the", "and", "ent", "ment", "able",
    "ness", "ist", "ver", "ung", "heit", "keit", "lich", "eau", "elle", "eux", "que", "aux", "ado", "cion", "mente", "oso", "idad", "xxx",
]
FEATURES = ["length", "digits", "letters", "classes", "transitions", "coverage", "path", "keyword", "harmless", "prefix", "assigned", "quoted", "run"]


def _removed(text: Column, pattern: str) -> Column:
    """Characters that a pattern covers."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(value: Column, before: Column) -> list[Column]:
    """The columns of FEATURES of a candidate and the text before it, as doubles.

    Length; share of digits, of letters, number of character classes; changes of character class per character;
    share covered by dictionary parts; whether it stands in a path or address; a keyword or a harmless word among
    the two words before; an issuer's prefix; assignment and quote just before; share of characters in repeats.
    """
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    near = F.regexp_extract(F.lower(before), NEAR, 0)
    flag = lambda c: c.cast("double")
    changes = F.regexp_count(value, F.lit("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"))
    word = lambda words: F.lit(r"(?:^|[^a-z0-9])(?:" + "|".join(map(re.escape, words)) + r")(?=$|[^a-z0-9])")
    return [
        n,
        _removed(value, "[0-9]") / n,
        _removed(value, "[A-Za-z]") / n,
        flag(value.rlike("[a-z]")) + flag(value.rlike("[A-Z]")) + flag(value.rlike("[0-9]")) + flag(value.rlike("[^A-Za-z0-9]")),
        changes / n,
        _removed(F.lower(value), "|".join(WORD_PARTS)) / n,
        flag(before.rlike(r"(?:[/\\.]|://)\S*$") | value.rlike("^/|/.*/")),
        flag(F.regexp_count(near, word(KEYWORDS)) > 0),
        flag(F.regexp_count(near, word(HARMLESS)) > 0),
        flag(value.rlike("^(?:" + "|".join(map(re.escape, PREFIXES)) + ")")),
        flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        flag(before.rlike(r"[\"'`]$")),
        _removed(value, r"(.)\1{2,}") / n,
    ]


def _let(value: Column, body) -> Column:
    """body of a value that is found once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column) -> Column:
    """Running sums of an array, in blocks: their cost grows with the array, not with its square."""
    none = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("bigint"))
    summed = lambda a: F.aggregate(a, none, lambda acc, x: F.concat(acc, F.array(last(acc) + x)))

    def within(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUNNING).cast("int")), lambda b: summed(F.slice(a, b * RUNNING + 1, RUNNING)))
        before = lambda bs: summed(F.transform(bs, last))
        return _let(blocks, lambda bs: _let(before(bs), lambda tops: F.flatten(F.transform(bs, lambda b, k: F.transform(b, lambda x: x + F.coalesce(F.get(tops, k - 1), F.lit(0).cast("bigint")))))))

    return F.when(F.size(numbers) > 0, _let(F.transform(numbers, lambda x: x.cast("bigint")), within)).otherwise(none)


def matches(text: Column) -> Column:
    """struct<found, parts>: the matches of CANDIDATE in a text and the texts between them, one more."""
    return F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE, -1).alias("parts"))


def candidates(matched: Column) -> Column:
    """array<struct<value, at: array<struct<start, k, before>>>> of the distinct candidates of matches(), each with its places.

    start counts characters from 0 to the value, k the match; before are the BEFORE characters before it.
    """
    last = lambda c: F.right(c, F.lit(BEFORE))
    value = lambda m: F.coalesce(F.nullif(F.regexp_extract(m, CANDIDATE, 1), F.lit("")), m)
    # a match has 8 characters or more, so those before the last BEFORE / 8 are out of reach
    reach = BEFORE // 8

    def placed(m: Column) -> Column:
        whole = F.zip_with(m["found"], F.slice(m["parts"], F.lit(1), F.size(m["found"])), lambda f, p: F.struct(f.alias("f"), value(f).alias("v"), last(p).alias("p"), (F.length(p) + F.length(f)).alias("n")))

        def each(rows: Column, ends: Column) -> Column:
            def one(r: Column, k: Column) -> Column:
                since = F.greatest(k - reach, F.lit(0))
                earlier = F.array_join(F.transform(F.slice(rows, since + 1, k - since), lambda x: F.concat(x["p"], last(x["f"]))), "")
                lead = F.left(r["f"], F.length(r["f"]) - F.length(r["v"]))
                return F.struct(r["v"].alias("value"), (F.get(ends, k) - F.length(r["v"])).cast("int").alias("start"), k.alias("k"), last(F.concat(earlier, r["p"], lead)).alias("before"))

            return F.array_sort(F.transform(rows, one))

        return _let(whole, lambda rows: _let(running(F.transform(rows, lambda r: r["n"])), lambda ends: each(rows, ends)))

    def grouped(rows: Column) -> Column:
        heads = F.filter(F.transform(rows, lambda r, k: F.when((k == 0) | (F.get(rows, k - 1)["value"] != r["value"]), k)), lambda k: k.isNotNull())

        def group(hs: Column) -> Column:
            def one(h: Column, g: Column) -> Column:
                places = F.slice(rows, h + 1, F.coalesce(F.get(hs, g + 1), F.size(rows)) - h)
                return F.struct(F.get(rows, h)["value"].alias("value"), F.transform(places, lambda r: F.struct(r["start"].alias("start"), r["k"].alias("k"), r["before"].alias("before"))).alias("at"))

            return F.transform(hs, one)

        return _let(heads, group)

    return _let(placed(matched), grouped)


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(value, before, label): n findings made by rule from their number, half of them secrets.

    Secrets are random hex and base64 after a keyword and an assignment, and issued keys anywhere; the others are checksums,
    revisions, addresses, long numbers, dated names, placeholders and compounds of word parts, some after a keyword too.
    """
    k = F.col("id")
    digest = lambda salt, size=256: F.sha2(F.concat(F.lit(salt), k.cast("string")), size)
    roll = lambda salt, of: F.pmod(F.xxhash64(k, F.lit(salt)), F.lit(of)).cast("int")
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), roll(salt, len(words)) + 1)
    b64 = F.regexp_replace(F.base64(F.unhex(F.concat(digest("b"), digest("c")))), "=+$", "")
    capitals = F.regexp_replace(F.upper(b64), "[+/]", "")
    lead = F.element_at(F.array(*map(F.lit, ["the words of ", "", "a long line that ends.\n", "on | in | at | ", "of: "])), roll("lead", 5) + 1)
    size = F.lit(20) + roll("size", 41)
    issued = F.when(roll("aws", 2) == 0, F.concat(pick(PREFIXES[:2], "p"), F.substring(capitals, 1, 16))).otherwise(F.concat(pick(PREFIXES[2:], "p"), F.substring(b64, F.lit(1), F.lit(16) + roll("size", 20))))
    secret = (
        F.when(roll("kind", 10) < 2, F.substring(digest("a"), 1, 40)).when(roll("kind", 10) == 2, F.substring(digest("a"), F.lit(1), size))
        .when(roll("kind", 10) == 3, F.substring(b64, F.lit(1), size)).when(roll("kind", 10) < 7, F.substring(digest("a"), F.lit(1), F.lit(10) + roll("size", 14))).otherwise(issued)
    )
    # keys of an issuer stand anywhere; other secrets are assigned to a name
    bare = (roll("kind", 10) > 6) & (roll("bare", 3) > 0)
    sign = pick([" = \"", "=", ": ", " = '", ":\"", "=\"", " : ", " "], "sign")
    compound = lambda join, m: F.concat_ws(join, *[pick(WORD_PARTS, f"c{i}") for i in range(m)])
    hexes = F.substring(digest("h"), F.lit(1), F.element_at(F.array(*map(F.lit, [16, 32, 40, 64])), roll("hl", 4) + 1))
    plain = (
        F.when(roll("kind", 7) == 0, hexes)
        .when(roll("kind", 7) == 1, F.concat(compound("", 5), roll("num", 1000).cast("string")))
        .when(roll("kind", 7) == 2, F.concat(compound("-", 4), F.lit("-20"), F.lpad(roll("yy", 99).cast("string"), 2, "0"), F.lit("-0"), (roll("mm", 9) + 1).cast("string")))
        .when(roll("kind", 7) == 3, F.repeat(pick(["x1", "0", "ab12", "1234567890", "X0"], "rep"), F.lit(12)))
        .when(roll("kind", 7) == 4, F.regexp_replace(F.substring(digest("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))
        .when(roll("kind", 7) == 5, F.concat(F.lit("/"), compound("/", 4), F.lit("/v"), roll("num", 90).cast("string")))
        .otherwise(F.rpad(F.conv(F.substring(digest("d"), 1, 14), 16, 10), 16 + roll("pad", 3), "7"))
    )
    prose = pick(["and ", "with ", "der ", "para ", "| ", "(", "ouer ", "que ", "the "], "nw")
    plain_before = (
        F.when((roll("kind", 7) == 0) | (roll("kind", 7) == 4), F.concat(lead, pick(HARMLESS, "hw"), sign))
        .when(roll("kind", 7) == 5, F.concat(lead, F.lit("https://www.example.com")))
        .when(roll("near", 3) == 0, F.concat(lead, pick(KEYWORDS, "kw"), sign))
        .otherwise(F.concat(lead, prose))
    )
    rows = spark.range(0, n, 1, 4)
    good = k % 2 == 0
    return rows.select(
        F.when(good, secret).otherwise(plain).alias("value"),
        F.when(good & bare, F.concat(lead, prose)).when(good, F.concat(lead, pick(KEYWORDS, "kw"), sign)).otherwise(plain_before).alias("before"),
        F.when(good, 1.0).otherwise(0.0).alias("label"),
    )


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A random forest on findings (value, before, label)."""
    rows = findings.select("label", *[c.alias(n) for n, c in zip(FEATURES, features(F.col("value"), F.col("before")))])
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(ready)


def forest_sql(model) -> list[str]:
    """Each tree as a SQL expression over the names of FEATURES that gives its vote, 0.0 or 1.0."""
    trees, lines = [], []
    for line in model.toDebugString.splitlines():
        if re.match(r"\s*Tree \d+", line):
            trees.append(lines := [])
        else:
            lines.append(line.strip())
    return [_tree(iter(lines)) for lines in trees]


def _tree(lines) -> str:
    line = next(lines)
    if line.startswith("Predict:"):
        return f"{float(line.split(':')[1])}D"
    feature, sign, limit = re.match(r"If \(feature (\d+) (<=|>) (\S+)\)", line).groups()
    yes = _tree(lines)
    assert next(lines).startswith("Else")
    no = _tree(lines)
    return f"(CASE WHEN {FEATURES[int(feature)]} {sign} {float(limit)!r}D THEN {yes} ELSE {no} END)"


@lru_cache(8)
def _votes(context, trees: int, depth: int, seed: int, n: int) -> str:
    """SQL of the share of trees that vote secret; fitted once a session, as its findings never change."""
    sql = forest_sql(fit(labelled_findings(SparkSession.active(), n), trees, depth, seed))
    return f"({' + '.join(sql)}) / {float(len(sql))}D"


def votes(spark: SparkSession, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, n: int = FINDINGS) -> str:
    return _votes(spark.sparkContext.applicationId, trees, depth, seed, n)


def _score(spark: SparkSession, uses: str) -> str:
    """SQL of a candidate's score: the most votes that one of its neighbourhoods gets; uses: name of the array of their FEATURES."""
    vote = re.sub(r"\b(" + "|".join(FEATURES) + r")\b", r"u.\1", votes(spark))
    return f"array_max(transform({uses}, u -> {vote}))"


def _described(matched: Column) -> Column:
    """The candidates of matches() with the FEATURES of each different neighbourhood in uses."""

    def entry(c: Column) -> Column:
        befores = F.array_distinct(F.transform(c["at"], lambda a: a["before"]))
        uses = F.transform(befores, lambda before: F.struct(*[f.alias(n) for n, f in zip(FEATURES, features(c["value"], before))]))
        return F.struct(c["value"].alias("value"), c["at"].alias("at"), uses.alias("uses"))

    return F.transform(candidates(matched), entry)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, value, start, occurrences, before, starts, uses, the FEATURES, score): every distinct candidate of every whole text.

    The FEATURES are of the first place; score is the highest of all places.
    """
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(_described(matches(whole_text(text_col)))).alias("c"))
    first = F.col("c.at")[0]
    named = found.select("doc_id", "c.value", first["start"].alias("start"), F.size("c.at").alias("occurrences"), first["before"].alias("before"), F.col("c.at.start").alias("starts"), "c.uses")
    described = named.select("*", *[c.alias(n) for n, c in zip(FEATURES, features(F.col("value"), F.col("before")))])
    return described.select("*", F.expr(_score(docs.sparkSession, "uses")).alias("score"))


def findings(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, occurrences, score, is_secret, masked, value_sha256, starts): a row for each distinct candidate of each text.

    start counts code points to the first place, starts to each; masked shows the first four characters. A place is where
    the text, read once from left to right, has the value as a whole run or an assigned value. Each is scored in its own
    neighbourhood: is_secret holds where more than threshold of the trees vote for one of them. The cost of a text grows
    with its length and its candidates, not with their product. Null and empty texts and texts without candidates give
    no row; null ids and repeated rows are kept; an empty table gives an empty result; other columns are ignored.
    """
    return scored(docs, id_col, text_col).select(
        "doc_id", F.col("start").cast("int").alias("start"), F.length("value").alias("length"), "occurrences", F.round("score", 6).alias("score"),
        (F.col("score") > threshold).alias("is_secret"), F.concat(F.substring("value", 1, 4), F.lit("***")).alias("masked"), F.sha2("value", 256).alias("value_sha256"), "starts",
    )


def redact(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """docs with every secret in text_col replaced by mask, columns and rows as they were; null texts stay null.

    Candidates are found, described and voted on within the row, so no row moves between tasks. The places of secrets are
    masked in one pass; what is left is then searched for each secret, longer ones first, so that a value that is a
    secret in one place is masked in all, inside longer words too. That last search is the only cost that grows with the
    product of the secrets found and the rest of the text.
    """
    spark = docs.sparkSession
    m, found, secret = free(docs, "matches", "found", "secrets")
    with_matches = docs.withColumn(m, F.when(F.col(text_col).isNotNull(), matches(F.col(text_col))))
    with_found = with_matches.withColumn(found, _described(F.col(m)))
    with_secrets = with_found.withColumn(secret, F.expr(f"filter({found}, c -> {_score(spark, 'c.uses')} > {float(threshold)}D)"))

    def masked(m: Column, secrets: Column) -> Column:
        places = F.array_sort(F.flatten(F.transform(secrets, lambda c: F.transform(c["at"], lambda a: F.struct(a["k"].alias("k"), F.length(c["value"]).alias("n"))))))
        # places come by match: cut the matches at them
        def cut_at(ps: Column) -> Column:
            part = lambda k: F.concat(F.get(m["parts"], k), F.get(m["found"], k))
            plain = lambda a, b: F.array_join(F.transform(F.slice(m["found"], a + 1, b - a), lambda f, i: F.concat(F.get(m["parts"], a + i), f)), "")
            since = lambda g: F.coalesce(F.get(ps, g - 1)["k"] + 1, F.lit(0))
            hidden = F.transform(ps, lambda p, g: F.concat(plain(since(g), p["k"]), F.left(part(p["k"]), F.length(part(p["k"])) - p["n"]), F.lit(mask)))
            end = F.coalesce(F.get(ps, F.size(ps) - 1)["k"] + 1, F.lit(0))
            return F.concat(F.array_join(hidden, ""), plain(end, F.size(m["found"])), F.get(m["parts"], F.size(m["parts"]) - 1))

        return _let(places, cut_at)

    ordered = F.array_sort(F.transform(secret, lambda c: F.struct((-F.length(c["value"])).alias("n"), c["value"].alias("value"))))
    rest = F.aggregate(ordered, masked(F.col(m), F.col(secret)), lambda t, c: F.replace(t, c["value"], F.lit(mask)))
    hidden = F.when(F.size(secret) > 0, rest).otherwise(F.col(text_col))
    return with_secrets.withColumn(text_col, hidden).drop(m, found, secret)
