"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, one of ordinary identifiers, paths, numbers and words; both are
counted from labelled samples.  What fixed patterns leave of a run of key-like characters is read
transition by transition: the ratio adds up, starts anew when ordinary text has used it up, and
where it rose above a margin the string is a secret, out to the next joiners.  So a key is found
beside an ordinary prefix too, and no rule on digits or letters comes before the models.
Everything runs on built-in functions, in the scan's own tasks: no shuffle, no Python.

Positions come from a split and an extraction of the same pattern, which alternate: gap, match,
gap, ...  ``length`` counts code points, so spans do too.  Sums over matches run in pieces of
PIECE, so that the time grows with their number, not with its square.

Defined results: a null text counts as an empty one (no spans); repeated rows are scanned one by
one; no rows give none; extra columns pass through; texts are scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, in the order in which spans with one start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: Runs that the models read.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = 66  # characters that a candidate can hold
SAMPLES = 4_000  # labelled samples of each kind at most
MARGIN = 18.0  # nats by which the random model must win
FALL = 12.0  # nats below its highest that end a string
LEAST = 16  # characters of a secret
PIECE = 256  # matches summed up together
_CODES = 128

#: Words of ordinary identifiers, from which labelled samples are put together.
WORDS = (
    "account active address array async backup base batch block buffer build button cache callback channel check "
    "class client clone cluster code column command common config connection content context control copy count "
    "create current data date default delete device document driver element email enable encode error event export "
    "field file filter final first format frame function global group handler header height host image import index "
    "input instance interface internal item label last layer length level library limit link list loader local lock "
    "machine main manager mapping match member memory message method model module monitor name network node number "
    "object offset option order output package page parent parser path pattern payload pending pipeline player port "
    "process profile project property provider proxy public query queue random range reader record register release "
    "remote render report request reset resource response result return router runtime sample schema search section "
    "select sequence server service session setting shared signal source stack start state status storage stream"
).split()


#: Syllables of which words outside that list are coined.
SYLLABLES = (
    "ba be bra che cor da den der dis ein en er est fer ga ger gen hin ing ion is ka ker la lich lin ma men ment mor na ner nom on or pa per pre pro ra re ri "
    "sa schen ser sion sta ta ten ter the tion to tra tri tur un ung va ver vo wa wer with"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(sample, random): n random strings and n ordinary ones, the same ones each time."""
    pick = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k))
    of = lambda salt, words: F.element_at(F.split(F.lit(" ".join(words)), " "), (pick(salt, len(words)) + 1).cast("int"))
    coined = lambda salt: F.concat(*[of(f"{salt}{k}", SYLLABLES) for k in range(3)])
    word = lambda salt: F.when(pick(f"{salt}?", 2) == 0, of(salt, WORDS)).otherwise(coined(salt))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    plain = F.base64(F.unhex(digest))
    letters = F.translate(plain, "+/=0123456789", "")
    kinds = [digest, F.upper(F.substring(digest, 1, 40)), plain, F.translate(plain, "+/=", ""), F.translate(plain, "+/=", "-_"), F.lower(letters), letters, F.upper(F.translate(plain, "+/=", ""))]
    rand = F.element_at(F.array(*kinds), (pick("kind", len(kinds)) + 1).cast("int"))
    a, b, c = word("a"), word("b"), word("c")
    number = F.rpad(F.conv(F.substring(digest, 1, 15), 16, 10), 16, "7")
    styles = [
        F.concat_ws("_", a, b, c, pick("num", 1000)), F.concat(a, F.initcap(b), F.initcap(c), pick("num", 100)), F.concat_ws("-", a, b, F.concat(F.lit("v"), pick("num", 10)), c),
        F.concat_ws("/", a, b, c, F.concat(F.initcap(word("d")), pick("num", 100), F.initcap(word("e")))), F.concat_ws("/", F.initcap(a), pick("num", 30), F.concat(F.initcap(b), F.initcap(c)), pick("more", 900)),
        F.upper(F.concat_ws("_", a, b, c)), F.concat(a, b, c), F.concat(F.initcap(a), b, c), F.upper(F.concat(a, b, c)), number,
        F.concat_ws("-", F.lit(1990) + pick("year", 40), F.lpad((pick("month", 12) + 1).cast("string"), 2, "0"), F.lpad((pick("day", 28) + 1).cast("string"), 2, "0"), a, pick("num", 1000)),
        F.repeat(F.substring(F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_=+/"), (pick("at", 67) + 1).cast("int"), 1), 24),
    ]
    plain_ones = F.element_at(F.array(*[x.cast("string") for x in styles]), (pick("style", len(styles)) + 1).cast("int"))
    ids = spark.range(n)
    return ids.select(rand.alias("sample"), F.lit(True).alias("random")).unionByName(ids.select(plain_ones.alias("sample"), F.lit(False).alias("random")))


def codes(text: Column) -> Column:
    """The character codes of an ASCII text, in one pass."""
    return F.transform(F.split(text, "", -1), lambda c: F.ascii(c))


def steps(code: Column) -> Column:
    """Which transitions the neighbours of an array of codes make."""
    n = F.greatest(F.size(code) - 1, F.lit(0))
    return F.zip_with(F.slice(code, 1, n), F.slice(code, 2, n), lambda a, b: a * _CODES + b)


def train(samples: DataFrame, margin_prior: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each transition; at most 128 * 128 cells come to the driver."""
    each = samples.where(F.length("sample") > 1).select("random", F.explode(steps(codes(F.col("sample")))).alias("step"))
    counts = each.groupBy("step", "random").count().where(f"step < {_CODES * _CODES}").collect()
    seen = {True: [0.0] * _CODES * _CODES, False: [0.0] * _CODES * _CODES}
    first = {True: [0.0] * _CODES, False: [0.0] * _CODES}
    for row in counts:
        seen[row["random"]][row["step"]] += row["count"]
        first[row["random"]][row["step"] // _CODES] += row["count"]
    log = lambda kind, s: math.log((seen[kind][s] + margin_prior) / (first[kind][s // _CODES] + margin_prior * ALPHABET))
    return [round(log(True, s) - log(False, s), 4) for s in range(_CODES * _CODES)]


def _gains(text: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of each transition of an ASCII text."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded into one literal
    return F.transform(steps(codes(text)), lambda s: F.element_at(table, s + 1))


def ratio(text: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a text of ASCII characters."""
    return F.aggregate(_gains(text, model), F.lit(0.0), lambda a, x: a + x)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(items: Column, zero: Column, step: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit(state, item)`` of all items, the state being that of ``step`` over the earlier ones.

    ``join`` adds the state of a whole piece to that of what comes before it.
    """
    count = F.ceil(F.size(items) / PIECE).cast("int")
    pieces = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(items, c * PIECE + 1, PIECE))).otherwise(F.array(items))
    none = F.array().cast(kind)
    begin = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))

    def one(piece: Column, at: Column) -> Column:
        add = lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(emit(s["at"], x))).alias("out"))
        return F.aggregate(piece, F.struct(at.alias("at"), none.alias("out")), add, lambda s: s["out"])

    def whole(found: Column) -> Column:
        before = F.aggregate(found, begin, lambda s, x: F.struct(join(s["at"], F.aggregate(x, zero, step)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(found, before, one))

    return F.when(F.size(items) > 0, _bind(pieces, whole)).otherwise(none)


SPAN = "struct<start:int,kind:int,end:int,match:string>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<match, gap>>: all matches in order, and how many code points come before each since the last."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = _bind(found, lambda m: F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda x, g: F.struct(x.alias("match"), g.alias("gap"))))
    return F.when(text.rlike(pattern), both).otherwise(F.array().cast("array<struct<match:string,gap:int>>"))


def _spans(matches: Column, kind: int) -> Column:
    """array<struct<start, kind, end, match>> of matches."""
    start = lambda a, x: a + x["gap"]
    end = lambda a, x: a + x["gap"] + F.length(x["match"])
    one = lambda a, x: F.struct(start(a, x).alias("start"), F.lit(kind).alias("kind"), end(a, x).alias("end"), x["match"].alias("match"))
    return _running(matches, F.lit(0), end, lambda a, b: a + b, one, f"array<{SPAN}>")


def _rebuilt(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with ``mark`` of each span in its place; spans, by start, know the greatest end before them."""
    part = lambda of, at, s: F.concat(F.substring(of, s["before"] - at + 1, F.greatest(s["start"] - s["before"], F.lit(0))), mark(s))

    def piece(found: Column) -> Column:
        at = F.element_at(found, 1)["before"]
        inside = F.substring(text, at + 1, F.greatest(F.element_at(found, -1)["start"] - at, F.lit(0)))
        return _bind(F.struct(inside.alias("of"), at.alias("at")), lambda x: F.array_join(F.transform(found, lambda s: part(x["of"], x["at"], s)), ""))

    count = F.ceil(F.size(spans) / PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda c: piece(F.slice(spans, c * PIECE + 1, PIECE)))
    last = F.element_at(spans, -1)
    upto = F.greatest(last["before"], last["end"])
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), F.substring(text, upto + 1, F.length(text)))).otherwise(text)


def _with_before(spans: Column) -> Column:
    """array<struct<start, end, before>> of spans by start."""
    most = lambda a, x: F.greatest(a, x["end"])
    one = lambda a, x: F.struct(x["start"].alias("start"), x["end"].alias("end"), a.alias("before"))
    return _running(spans, F.lit(0), most, lambda a, b: F.greatest(a, b), one, "array<struct<start:int,end:int,before:int>>")


def _blank(s: Column) -> Column:
    return F.repeat(F.lit("\n"), F.greatest(s["end"] - F.greatest(s["start"], s["before"]), F.lit(0)))


JOINERS = "+-/=_"  # characters of a candidate that aren't letters or digits


def _secrets_of(run: Column, model: list[float], margin: float) -> Column:
    """array<struct<start, kind, end>> of a candidate's secrets.

    Where the sum of gains, from its last zero to its highest, rises above the margin, out to the next joiners.
    The run is read in pieces of bytes, so neither time nor memory grows faster than its length; transition k
    joins the characters k and k + 1.
    """
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded into one literal
    codes_ = [ord(c) for c in JOINERS]
    n = F.length(run["match"])
    count = F.ceil(n / PIECE).cast("int")

    def within(raw: Column) -> Column:
        own = lambda p: F.translate(F.substring(raw, p * PIECE + 1, F.lit(PIECE)).cast("string"), JOINERS, "_" * len(JOINERS))
        first = lambda p: _bind(F.instr(own(p), "_"), lambda at: F.when(at > 0, p * PIECE + at - 1))
        backwards = F.transform(F.reverse(F.sequence(F.lit(0), count - 1)), first)
        nearest = _running(backwards, F.lit(None).cast("int"), lambda a, x: F.coalesce(x, a), lambda a, b: F.coalesce(b, a), lambda a, x: a, "array<int>")
        pieces = F.zip_with(F.sequence(F.lit(0), count - 1), F.reverse(nearest), lambda p, at: F.struct(p.alias("p"), F.coalesce(at, n).alias("next")))
        return F.aggregate(pieces, state, lambda s, x: read(raw, own, s, x), lambda s: last(raw, s))

    number = lambda x: F.lit(x).cast("int")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    begin = {"k": number(0), "sum": F.lit(0.0), "lead": number(0), "best": F.lit(0.0), "to": number(0), "after": number(-1), "joint": number(0), "last": F.struct(number(-1).alias("lead"), number(-1).alias("end")), "out": none}
    state = F.struct(*[v.alias(c) for c, v in begin.items()])

    def emitted(s: Column, out: Column, end: Column) -> Column:
        """``out`` and the string that ends now, unless it is short, or the one before over again."""
        fresh = (end - s["lead"] >= LEAST) & ((s["last"]["lead"] != s["lead"]) | (s["last"]["end"] != end))
        found = F.struct((run["start"] + s["lead"]).alias("start"), F.lit(3).alias("kind"), (run["start"] + end).alias("end"))
        return F.when(fresh, F.concat(out, F.array(found))).otherwise(out)

    def read(raw: Column, own: Callable[[Column], Column], s: Column, x: Column) -> Column:
        """The state after one more piece."""
        at = x["p"] * PIECE

        def items(code: Column) -> Column:
            many = F.greatest(F.size(code) - 1, F.lit(0))
            return F.zip_with(F.slice(code, 1, many), F.slice(code, 2, many), lambda a, b: F.struct(F.element_at(table, a * _CODES + b + 1).alias("gain"), a.isin(codes_).alias("joiner")))

        def step(t: Column, y: Column) -> Column:
            k, total = t["k"], t["sum"] + y["gain"]
            over = (total <= 0) | (total < t["best"] - FALL)
            higher = ~over & (total > t["best"])
            joint = F.when(y["joiner"], k + 1).otherwise(t["joint"])
            after = F.when((t["after"] < 0) & (t["to"] <= k) & y["joiner"], k).otherwise(t["after"])
            inside = _bind(F.call_function("locate", F.lit("_"), own(x["p"]), k - at + 2), lambda i: F.when(i > 0, at + i - 1).otherwise(x["next"]))
            end = F.when(after >= 0, after).otherwise(inside)
            done = over & (t["best"] > margin)
            moved = {
                "k": k + 1, "sum": F.when(over, 0.0).otherwise(total), "lead": F.when(over, joint).otherwise(t["lead"]), "best": F.when(over, 0.0).when(higher, total).otherwise(t["best"]),
                "to": F.when(higher, k + 2).otherwise(t["to"]), "after": F.when(over | higher, -1).otherwise(after), "joint": joint,
                "last": F.when(done, F.struct(t["lead"].alias("lead"), end.alias("end"))).otherwise(t["last"]), "out": F.when(done, emitted(t, t["out"], end)).otherwise(t["out"]),
            }
            return F.struct(*[v.alias(c) for c, v in moved.items()])

        piece = F.substring(raw, at + 1, F.lit(PIECE + 1)).cast("string")
        empty = F.struct(*[(none if c == "out" else s[c]).alias(c) for c in begin])
        after_it = _bind(items(codes(piece)), lambda found: F.aggregate(found, empty, step))
        return _bind(after_it, lambda t: F.struct(*[(F.concat(s["out"], t["out"]) if c == "out" else t[c]).alias(c) for c in begin]))

    def last(raw: Column, s: Column) -> Column:
        """All of the run's strings, with one that its end closes."""
        joins = (s["to"] < n) & F.substring(raw, n, F.lit(1)).cast("string").isin(list(JOINERS))
        end = F.when(s["after"] >= 0, s["after"]).when(joins, n - 1).otherwise(n)
        return F.when(s["best"] > margin, emitted(s, s["out"], end)).otherwise(s["out"])

    return _bind(F.encode(run["match"], "utf-8"), within)


def scan_secrets(df: DataFrame, text_col: str = "text", model: list[float] | None = None, margin: float = MARGIN, to: str = "secret_spans", base_to: str = "base_spans") -> DataFrame:
    """``df`` with two array columns of struct<start, kind, end> (kind: a place in KINDS).

    ``base_to``: matches of the fixed patterns, leftmost and non-overlapping by kind.  ``to``: these
    and what the models add beside them, by start, then kind.
    """
    if model is None:
        model = train(labelled_samples(df.sparkSession))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    both = _bind(_base_spans(text), lambda base: F.struct(base.alias(base_to), _all_spans(text, base, model, margin).alias(to)))
    # A generator of one row: no filter on the spans is pushed below it, so they are worked out once.
    return df.drop(base_to, to).select("*", F.inline(F.array(both)))


def _base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the fixed patterns' matches, by start, then kind."""
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    strong = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8
    found = [
        _bind(_matches(text, ASSIGN), lambda m: bare(F.filter(_spans(m, 0), strong))),
        _bind(_matches(text, ACCESS), lambda m: bare(F.filter(_spans(m, 1), lambda s: F.length(s["match"]) >= 16))),
        _bind(_matches(text, HEX), lambda m: bare(_spans(m, 2))),
    ]
    return F.array_sort(F.concat(*found))


def _all_spans(text: Column, base: Column, model: list[float], margin: float) -> Column:
    """``base`` and what the models find beside it."""
    blank = _bind(_with_before(base), lambda b: _rebuilt(text, b, _blank))  # base spans are blank lines in it
    rest = F.when(F.size(base) > 0, blank).otherwise(text)
    runs = _bind(_bind(rest, lambda t: _matches(t, CANDIDATE)), lambda m: _spans(m, 3))
    more = F.flatten(F.transform(runs, lambda s: _secrets_of(s, model, margin)))
    return _bind(more, lambda x: F.when(F.size(x) > 0, F.array_sort(F.concat(base, x))).otherwise(base))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark; ``spans``, by start, should be a column."""
    fresh = lambda s: F.when(s["start"] >= s["before"], F.lit(mark)).otherwise(F.lit(""))
    return F.when(F.size(spans) > 0, _bind(_with_before(spans), lambda s: _rebuilt(text, s, fresh))).otherwise(text)
