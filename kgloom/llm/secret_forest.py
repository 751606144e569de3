"""Secret scans: candidates by regex, false positives removed by a random forest.

Candidates are long runs of token characters with a digit or with letters of both cases, keys with known
prefixes, and, of any length and signs, values after secret words with = or : and passwords in URLs.
Features are the candidate's length, its transitions between character classes, how much of it dictionary
fragments cover, words of the path, and words and signs next to it.  The forest is trained on labelled
findings and is then written out as one SQL expression, so that scanning and redacting are plain column
expressions over whole texts.

The labelled findings come from two generators with ``FINDINGS`` seeds in all, run in Spark itself: keys and
digests in running text against identifiers, and values told by what stands before them against ordinary
values in like places.  The words around them are drawn from the dictionary; no table is looked at.

Cases: null and empty texts have no candidates and stay as they are; a null path has no words; candidates
next to the start or end of a text have empty neighbours; texts of any length are scanned whole; rows that
repeat in doc_id and text give their findings once, and are redacted each; a share of trees equal to the
threshold makes a secret; an empty table gives an empty one; ``findings`` reads no other columns, whatever
their names, and ``redacted`` keeps them.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.llm.storage import collect_garbage, written

NEAR = 48
FINDINGS, TREES, DEPTH, SEED = 4000, 15, 6, 11
#: Share of trees from which a candidate is a secret; under one half, as a missed secret costs more than a masked token.
THRESHOLD = 0.4
MASK = "[SECRET]"

#: Fragments of ordinary words and identifiers.
DICTIONARY = "the and ing tion ment ness able less ful over under inter pre pro con com for with from that this have not you all can her was one our out day get has him his how man new now old see two way who boy did its let put say she too use file name user data time page item list test case type code text word line path home html http https www index image photo video song news blog post article release version build update config default example sample demo report summary final draft backup copy window button table column value number string object class function method return import export module package service server client request response error event order account project issue ticket january february march april june july august september october november december monday friday red blue green black white light dark open close start stop left right first last next high low small large long short good true false null none main test local global public office school music water river garden street house table people world place group company country number family power money change market health system program question study night point area story fact month book eye job side head book hour game line member law car city name team minute idea body back parent face level door health art war history party result morning reason research girl guy moment air teacher force education".split()
DICTIONARY = list(dict.fromkeys(DICTIONARY))
SECRET_WORDS = "pass|pwd|secret|token|api|key|auth|credential|bearer|private|access|signature"
PLAIN_WORDS = "commit|sha|md5|checksum|hash|digest|uuid|guid|version|revision|build|isbn|serial|order|invoice|see|ref|page|figure|http|www|id "
PATH_WORDS = "test|example|sample|mock|fixture|demo|doc|spec"
#: Values of these are passwords whatever they look like.
PASS_WORDS = "pass|pwd|secret|credential"

#: Keys whose first characters tell what they are.
KNOWN = r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])|(?:gh[pousr]_|github_pat_|sk[-_]|AIza)[A-Za-z0-9_-]{16,}|xox[a-z]-[A-Za-z0-9-]{8,}|eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){1,2}"
#: Runs of at least 16 token characters with a digit, or with a lower-case letter and a capital behind the first sign.
RUN = r"(?:(?=[A-Za-z+/_-]*[0-9])|(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-][a-z0-9+/_-]*[A-Z]))[A-Za-z0-9+/_-]{16,}={0,2}"
_SAYS = rf"(?<=(?i:{SECRET_WORDS})[A-Za-z0-9_-]{{0,40}}\\?[\"']?[ \t]{{0,40}}[:=]{{1,2}}>?[ \t]{{0,40}}"
#: Neither the scheme of an authorization nor a URL is a value; what follows or is in them is.
_VALUE = r"(?!(?i:bearer|basic)[ \t]|[A-Za-z][A-Za-z0-9+.-]*://)"
_QUOTED = "|".join(rf"(?<={q}){_SAYS}\\?{q}){_VALUE}[^{q}\r\n]+(?={q})" for q in "\"'")
#: Possessive, as other loops of groups take stack for each sign.
_BARE = rf"(?<=[:=> \t])(?<![^:=> \t][ \t])(?![:=>]){_SAYS}){_VALUE}(?:(?![&;][A-Za-z0-9_ .-]{{1,40}}=|[,.;:)\]}}&]+(?:[\s\"'<>]|$))[^\s\"'<>])++"
_BEARER = r"(?<=[ \t])(?<=\b(?i:bearer|basic)[ \t]{1,8})(?<=[:=\"'][ \t]{0,8}(?i:bearer|basic)[ \t]{1,8})[A-Za-z0-9._~+/-]+={0,2}"
_IN_URL = r"(?<=:)(?<=://[^\s:/@\"'<>]{0,200}:)[^\s/\"'<>]+(?=@)"
CANDIDATE = rf"{_IN_URL}|{_QUOTED}|{_BARE}|{_BEARER}|(?<![A-Za-z0-9+/_-])(?:{KNOWN}|{RUN})"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Named features of a candidate with the text before and behind it."""
    size = F.length(candidate).cast("double")
    low, left = F.lower(candidate), F.lower(F.coalesce(before, F.lit("")))
    has = lambda text, words: F.coalesce(text.rlike(words).cast("double"), F.lit(0.0))
    fragments = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    return {
        "length": F.least(size, F.lit(200.0)),
        "digits": _count(candidate, "[0-9]") / size,
        "uppers": _count(candidate, "[A-Z]") / size,
        "signs": _count(candidate, "[+/_=-]") / size,
        "marks": _count(candidate, "[^A-Za-z0-9+/_=-]") / size,
        "left_out": has(low, r"^[$<{%\[]|^(your|my|the|some|example)[^a-z]|^(.)\2+$|^(none|null|nil|true|false|undefined|redacted|hidden)$|[(\[]"),
        "turns": _count(candidate, "(?<=[a-z])(?=[0-9A-Z])|(?<=[0-9])(?=[a-zA-Z])|(?<=[A-Z])(?=[0-9])") / size,
        "same": _count(candidate, r"(.)\1") / size,
        "vowels": _count(low, "[aeiou]") / size,
        "beyond_hex": _count(low, "[g-z]") / size,
        "syllables": _count(low, "[bcdfghjklmnpqrstvwxz][aeiouy]") / size,
        "covered": (size - F.length(F.regexp_replace(low, fragments, ""))) / size,
        "uuid": has(low, "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "date": has(low, "(19|20)[0-9]{2}[-_/]?[01][0-9][-_/]?[0-3][0-9]"),
        "known": has(candidate, "^(AKIA|ASIA)[0-9A-Z]{16}$|^(gh[pousr]|github_pat)_|^sk[-_]|^xox[a-z]-|^AIza|^eyJ"),
        "path": has(F.lower(F.coalesce(path, F.lit(""))), PATH_WORDS),
        "asked": has(left, f"({SECRET_WORDS})[^ ]* *[=:]? *[\"']?$"),
        "password": has(left, f"({PASS_WORDS})[a-z0-9_-]*[\"']? *[=:]+>? *[\"']?$"),
        "firm": has(left, f"({PASS_WORDS})[a-z0-9_-]*[\"']? *([=:]+>? *[\"']|=>? *)$"),
        "equals": has(left, "=>? *[\"']?$"),
        "in_url": has(left, r"://[^\s/@]*:$"),
        "near_secret": has(left, SECRET_WORDS),
        "near_plain": has(left, PLAIN_WORDS),
        "assigned": has(left, "[=:] *[\"']?$"),
        "quoted": has(F.coalesce(after, F.lit("")), "^[\"']"),
    }


def labelled_findings(spark: SparkSession, n: int = FINDINGS, start: int = 0) -> DataFrame:
    """Findings with labels, one for each seed from ``start`` on: random keys in several alphabets against digests, identifiers, words, dates and counters.

    Each kind stands in neighbourhoods of its own sort most of the time and of the other sort at times.
    """
    pick = lambda i, words: f"element_at(array({', '.join(repr(w) for w in words)}), 1 + cast(pmod(xxhash64(id, {i}), {len(words)}) as int))"
    hexed = lambda i, k: f"substr(sha2(concat(id, ':{i}'), 256), 1, {k})"
    b64 = lambda i, k: f"substr(regexp_replace(base64(unhex(sha2(concat(id, ':{i}'), 512))), '[^A-Za-z0-9]', ''), 1, {k})"
    letters = lambda i, k: f"substr(regexp_replace(base64(unhex(sha2(concat(id, ':{i}'), 512))), '[^A-Za-z]', ''), 1, {k})"
    word = lambda i: pick(i, [w for w in DICTIONARY if len(w) > 2])
    number = lambda i, k: f"cast(pmod(xxhash64(id, {i}), {10**k}) as string)"
    secrets = [
        f"concat('AKIA', upper({b64(1, 16)}))",
        hexed(2, 40),
        hexed(3, 18),
        b64(4, 40),
        f"concat('ghp_', {b64(5, 36)})",
        f"concat('sk-', {b64(6, 32)})",
        b64(7, 20),
        hexed(8, 32),
        letters(40, 20),
    ]
    plain = [
        f"concat({hexed(1, 8)}, '-', substr(md5(concat(id,'b')),1,4), '-', substr(md5(concat(id,'c')),1,4), '-', substr(md5(concat(id,'d')),1,4), '-', substr(md5(concat(id,'e')),1,12))",
        hexed(2, 40),
        hexed(8, 32),
        f"concat({word(11)}, '_', {word(12)}, '_', {word(13)}, '_', {number(14, 3)})",
        f"concat(initcap({word(15)}), initcap({word(16)}), initcap({word(17)}), initcap({word(18)}), {number(19, 2)})",
        f"concat('20', lpad({number(20, 2)}, 2, '0'), '-0', {number(21, 1)}, '-1', {number(22, 1)}, '-', {word(23)}, '-', {word(24)})",
        f"lpad(concat({number(25, 9)}, {number(26, 9)}), 18, '7')",
        f"concat({word(27)}, '/', {word(28)}, '/', {word(29)}, '/', {number(30, 4)})",
        f"concat('EXAMPLE', upper({word(31)}), '000000', {number(32, 2)})",
        f"concat({word(41)}, initcap({word(42)}), initcap({word(43)}), initcap({word(44)}))",
        f"concat(initcap({word(45)}), '/', {word(46)}, '-', initcap({word(47)}), '/', {word(48)})",
    ]
    asks = ["password=", "token = \"", "api_key: ", "secret=\"", "Authorization: Bearer ", "aws access key ", "and the ", "with ", "key ", "credentials: "]
    tells = ["commit ", "sha256 checksum: ", "see https://www.example.org/", "uuid=", "version ", "order id ", "file ", "in the ", "build ", "page "]
    made = spark.range(start, start + n).selectExpr("id", "cast(id % 2 as int) as label", "pmod(xxhash64(id, 77), 100) as odd", "pmod(xxhash64(id, 78), 100) as loose")
    case = lambda kinds, i: "CASE " + " ".join(f"WHEN pmod(xxhash64(id, {i}), {len(kinds)}) = {j} THEN {k}" for j, k in enumerate(kinds)) + " END"
    # Digests are secrets only where something asks for one.
    made = made.selectExpr("id", "label", "odd", "loose", f"CASE WHEN label = 1 THEN {case(secrets, 79)} ELSE {case(plain, 80)} END AS candidate")
    digest = F.col("candidate").rlike("^[0-9a-f]+$")
    asked = F.when(F.col("label") == 1, digest | (F.col("odd") < 60)).otherwise(~digest & (F.col("odd") < 8))
    made = made.withColumn("asked", asked)
    talk = lambda i: f"concat({word(i)}, ' ', {word(i + 1)}, ' ')"
    loose = made.where("pmod(xxhash64(id, 95), 3) > 0").selectExpr(
        "candidate",
        f"CASE WHEN asked AND NOT (label = 1 AND candidate rlike '^[0-9a-f]+$') THEN concat({talk(120)}, {pick(81, asks)}) WHEN asked THEN concat({talk(122)}, {pick(82, asks[:5])}) WHEN label = 0 THEN concat({talk(124)}, {pick(83, tells)}) ELSE {talk(126)} END AS before",
        "CASE WHEN asked AND loose < 40 THEN '\" in' ELSE ' in the' END AS after",
        f"CASE WHEN label = 0 AND loose < 30 THEN concat('tests/', {word(85)}) ELSE concat('src', cast(id % 20 as string)) END AS path",
        "cast(label as double) AS label",
    )
    # A third are values that only their place tells, told by a secret word or a URL.
    sign = lambda i: pick(i, ["!", "&", "#", "$", "%", "*", "?", "@", ".", "-"])
    passwords = [
        f"concat(translate({word(50)}, 'oae', '04@'), {sign(51)}, {number(52, 2)})",
        f"concat(initcap({word(53)}), {number(54, 3)}, {sign(55)})",
        f"concat({b64(56, 5)}, {sign(57)}, {b64(58, 4)})",
        b64(59, 9),
        letters(60, 12),
        letters(61, 20),
        f"concat({word(62)}, {number(63, 2)}, {sign(64)}, {b64(65, 3)})",
    ]
    phrases = [f"concat_ws('-', {word(66)}, {word(67)}, {word(68)}, {word(69)})", f"concat_ws(' ', {word(66)}, {word(67)}, {word(68)}, {word(69)})", word(70)]
    # Names and words of no dictionary, spelt as they are spoken.
    spoken = lambda i: "concat(" + ", ".join([pick(i, ["b", "br", "d", "gr", "h", "j", "k", "l", "m", "n", "p", "r", "s", "sm", "st", "t", "w"]), pick(i + 1, ["a", "e", "i", "o", "u"]), pick(i + 2, ["l", "m", "n", "r", "s", "t", "th", "ck", "ss"]), pick(i + 3, ["", "", "a", "er", "on", "ing", "o", "ia"])]) + ")"
    ordinary = [f"initcap({spoken(130)})", spoken(134), word(71), f"initcap({word(72)})", f"concat({word(73)}, '_', {word(74)})", f"concat({word(75)}, ' ', {word(76)})", number(86, 3), f"concat({word(87)}, '.', {word(88)})"]
    fillers = [f"concat('${{', upper({word(89)}), '}}')", f"concat('<', {word(90)}, '>')", f"concat('your_', {word(91)})", f"concat({word(92)}, '(', {word(93)}, ')')", pick(94, ["null", "none", "true", "false", "********", "xxxxxxxx"])]
    keys = ["api_key: ", "token=", 'token = "', "auth: ", "access_key=", 'secret_key: "']
    holders = ["password=", 'password = "', "pwd=", "passwd: ", 'db_password: "', "secret=", 'secret="', "credential: ", "pass = '"]
    firm = ["password=", 'password = "', "pwd=", 'db_password: "', "pass = '"]
    urls = ["postgres://app:", "https://user:", "redis://:", "amqp://guest:"]
    placed = made.where("pmod(xxhash64(id, 95), 3) = 0").selectExpr("id", "label", "pmod(xxhash64(id, 96), 10) AS sort")
    value = f"CASE WHEN label = 1 AND sort < 7 THEN {case(passwords, 97)} WHEN label = 1 THEN {case(phrases, 98)} WHEN sort < 6 THEN {case(ordinary, 99)} ELSE {case(fillers, 100)} END"
    told = (
        f"CASE WHEN label = 1 AND sort < 2 THEN {pick(101, urls)} WHEN label = 1 AND sort < 4 THEN {pick(102, keys)} WHEN label = 1 AND sort < 7 THEN {pick(103, holders)} WHEN label = 1 THEN {pick(104, firm)}"
        f" WHEN sort < 4 THEN {pick(105, [*keys, 'author: ', 'key: ', 'access: ', 'keyboard = '])} WHEN sort < 6 THEN {pick(106, ['password: ', 'pass: ', 'secret: '])} ELSE {pick(107, [*keys, *holders])} END"
    )
    placed = placed.selectExpr("id", "label", f"{value} AS candidate", f"{told} AS told")
    return loose.unionByName(
        placed.selectExpr(
            "candidate",
            f"concat({talk(128)}, told) AS before",
            "CASE WHEN told rlike '://' THEN '@db.' WHEN told rlike '[\"\\']$' THEN concat(right(told, 1), ' in') ELSE ' in the' END AS after",
            "concat('src', cast(id % 20 as string)) AS path",
            "cast(label as double) AS label",
        )
    )


def _tree_sql(lines: list[tuple[int, str]], at: int) -> tuple[str, int]:
    """One node of a tree's printed form as SQL, and the line behind it."""
    depth, text = lines[at]
    if text.startswith("Predict:"):
        return text.split(":")[1].strip(), at + 1
    test = re.fullmatch(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", text)
    yes, at = _tree_sql(lines, at + 1)
    no, at = _tree_sql(lines, at + 1)  # past the line of its Else
    return f"IF(f[{test[1]}] <= {test[2]}D, {yes}, {no})", at


def forest_sql(printed: str) -> str:
    """The share of trees that say 1, as SQL over an array ``f``."""
    trees, lines = [], []
    for line in printed.splitlines()[1:]:
        if line.strip().startswith("Tree "):
            lines = []
            trees.append(lines)
        elif line.strip():
            lines.append((len(line) - len(line.lstrip()), line.strip()))
    votes = [_tree_sql(t, 0)[0] for t in trees]
    return f"(({' + '.join(votes)}) / {float(len(votes))}D)"


def fit(spark: SparkSession, findings: DataFrame | None = None) -> str:
    """Train on labelled findings (candidate, before, after, path, label) and give the forest as SQL."""
    findings = labelled_findings(spark) if findings is None else findings
    made = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    # Made and measured in two stages, as the code of both is too long for one.
    rows = findings.repartition(8).select("label", *[c.alias(k) for k, c in made.items()])
    rows = VectorAssembler(inputCols=list(made), outputCol="features").transform(rows).select("label", "features")
    rows = written(rows, "secret-findings")
    collect_garbage(spark)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(rows)
    shown = forest_sql(model.toDebugString)
    collect_garbage(spark)
    return shown


def _hits(text: Column) -> tuple[Column, Column]:
    """Gaps between candidates and the candidates; null where a text has none."""
    some = text.rlike(CANDIDATE)
    return F.when(some, F.split(text, CANDIDATE, -1)), F.when(some, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))


def _measured(hits: Column, gaps: Column, path: Column) -> Column:
    """The features of each candidate as an array."""

    def one(hit: Column, i: Column) -> Column:
        values = features(hit, F.right(F.get(gaps, i), F.lit(NEAR)), F.substring(F.get(gaps, i + 1), 1, 4), path)
        return F.array(*values.values())

    return F.transform(hits, one)


def findings(docs: DataFrame, forest: str, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: place (code points), the candidate, the forest's share and decision.

    Rows that repeat in doc_id and text give their findings once.
    """
    gaps, hits = _hits(F.col("body"))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_k")
    rows = docs.select(F.col(doc_id).alias("doc_id"), key, F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("body"))
    rows = rows.select("doc_id", "_k", "path", F.xxhash64("body").alias("_h"), gaps.alias("gaps"), hits.alias("hits")).where(F.col("hits").isNotNull())
    gap = lambda i: F.get("gaps", i)
    each = F.transform("hits", lambda hit, i: F.struct(hit.alias("candidate"), F.length(gap(i)).alias("gap"), F.right(gap(i), F.lit(NEAR)).alias("before"), F.substring(gap(i + 1), 1, 4).alias("after")))
    parts = rows.select("doc_id", "_k", "_h", "path", F.posexplode(each).alias("at", "c")).select("doc_id", "_k", "_h", "path", "at", "c.*")
    made = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    parts = parts.select("doc_id", "_k", "_h", "at", "candidate", "gap", F.array(*made.values()).alias("f")).dropDuplicates(["_k", "_h", "at"])
    before = W.partitionBy("_k", "_h").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("candidate")).over(before) - F.length("candidate")
    out = parts.select("doc_id", start.cast("long").alias("start"), "candidate", F.expr(forest).alias("chance"))
    return out.select("doc_id", "start", (F.col("start") + F.length("candidate")).alias("end"), "candidate", "chance", (F.col("chance") >= THRESHOLD).alias("is_secret"))


def redacted(docs: DataFrame, forest: str, text: str = "text", path: str = "source") -> DataFrame:
    """``docs`` with every candidate that the forest calls a secret masked; map-side, all other columns kept."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    body, where = F.col("_row")[text], F.col("_row")[path].cast("string")
    gaps, hits = _hits(body)
    rows = rows.select("_row", gaps.alias("_gaps"), hits.alias("_hits"))
    rows = rows.select("_row", "_gaps", "_hits", _measured(F.col("_hits"), F.col("_gaps"), where).alias("_f"))
    rows = rows.select("_row", "_gaps", "_hits", F.expr(f"transform(_f, f -> {forest})").alias("_chance"))
    masked = F.transform("_hits", lambda hit, i: F.concat(F.get("_gaps", i), F.when(F.get("_chance", i) >= THRESHOLD, F.lit(MASK)).otherwise(hit)))
    joined = F.concat(F.array_join(masked, ""), F.element_at("_gaps", -1))
    new = F.when(F.col("_hits").isNull(), body).otherwise(joined)
    return rows.select(*[(new if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])
