"""Problem 8: texts cut off by a field limit or in transfer.

Two kinds of evidence, each in log-odds and each fitted on the corpus.

Lengths: per source and unit (characters, UTF-8 bytes) the lengths are log-normal,
right-censored at limits that apply to a share of the texts. Limits are the lengths
(or short windows below a length, where a cut falls back to a word) that hold far
more texts than the fit; location and spread are fitted by maximum likelihood (EM over
the length histogram), and a text at a limit gets the posterior of being censored.

Endings: every text falls into a class of endings. The classes of an open ending say
how texts with the same beginning of the last line usually fare: whether that line
goes on elsewhere to a full sentence, or stops there too (a signature, an aside). How
often cut and whole texts have a class is fitted against the length posterior: texts
at limits show the endings of cut texts, the others those of whole texts, each
mixed with some of the other kind (``calibrated``). A text is cut if both kinds of
evidence together say so, so a text at a limit needs less of an ending than a text at
none.

All statistics are counted over all different texts, so copies of a text are no
evidence for it; each text is judged once a source, and its documents share the verdict.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantus.plans.storage import cut

WINDOWS = (1, 5, 13)
DEPTH = 3  # words of a line's beginning that are looked up, the longest known one counts
WANTED = 200_000  # beginnings (8 bytes each) that are broadcast to the sentences; more are joined by shuffle
PRIOR = {"torn": 1.0, "open": 8.0, "open marked": 2.0}  # cut texts seen before any data; open ones are spread as the open endings that no formula explains
SMOOTH = 0.5
LIMITS = "source string, unit string, low bigint, high bigint, posterior double, share double, mu double, sigma double"
CHORD = r"\b[A-G][#b♯♭]?(?:maj|min|dim|aug|sus|add|m)?\d*(?:b5)?(?:/[A-G][#b♯♭]?)?(?![\p{L}\d])"
MARK = r"\s*(?:…|\.{2,}|\[(?:…|\.{2,}|\p{L}{3,12})\]|\((?:…|\.{2,}|more|continued|truncated)\)|<(?:more|cut|truncated)>)$"


def _shape(text: Column) -> Column:
    """A line with its numbers and chord names levelled."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, CHORD, "K0")), r"\d+", "0")


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _texts(documents: DataFrame) -> DataFrame:
    """key, text, sources: every different text, with the sources of its documents (none where no document has an id)."""
    source = F.when(F.col("doc_id").isNotNull(), F.coalesce("source", F.lit("")))
    return documents.where("text is not null").groupBy("text").agg(F.collect_set(source).alias("sources")).select(_key(F.col("text")).alias("key"), "text", "sources")


def _ends(texts: DataFrame) -> DataFrame:
    """Per text: its last line or sentence (``line``), whether an omission mark follows it, and how it ends."""
    df = texts.where((F.size("sources") > 0) & F.col("text").rlike(r"[\p{L}\p{N}]"))
    df = df.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    tail = F.regexp_replace("text", r"(?:</[\p{L}\p{N}]+>|[\s\p{Z}\p{Cf}])+$", "")
    df = df.withColumn("tail", tail)
    df = df.withColumn("marked", F.col("tail").rlike(MARK)).withColumn("body", F.regexp_replace("tail", MARK, ""))
    line = F.regexp_extract("tail", r"(?s)^(?:.*(?:[.!?。！？…][\"'”’)\]]*[\s\p{Z}]|\n|\r))?(.*)$", 1)
    line = F.when(F.col("marked"), F.regexp_extract("body", r"(?s)^(?:.*(?:[.!?。！？][\"'”’)\]]*[\s\p{Z}]|\n|\r))?(.*)$", 1)).otherwise(line)
    df = df.withColumn("line", line).withColumn("shape", F.concat(_shape(F.col("line")), F.when(F.col("marked"), F.lit(" …")).otherwise(F.lit(""))))
    body = F.col("body")
    kind = (
        F.when(body.rlike(r"<[^<>]{0,200}$") & ~body.rlike(r"<\d"), "torn")  # inside a tag
        .when(body.rlike("�$"), "torn")  # half a character
        .when(body.rlike(r"(?:^|[\s\p{Z}])0\.$"), "number")
        .when(body.rlike(r"[.!?。！？][\"'”’»)\]]*$"), "sentence")
        .when(body.rlike(r"[\p{L}\p{N}\p{M},;:/#&+=(\[{«“‘\-–—_@]$") & ~body.rlike(r":-?[()DP]$"), "open")
        .otherwise("symbol")
    )
    return df.withColumn("kind", kind).drop("text", "tail", "body")


def _words(line: Column) -> Column:
    """The levelled words of a line, without markup."""
    return F.split(F.trim(_shape(F.regexp_replace(line, r"<[^<>]*>", " "))), r"\s+")


def _beginnings(words: Column, most: Column) -> Column:
    """(depth, hash) of the first 1 to ``DEPTH`` words, where more words than ``most`` allows do not follow."""
    depths = F.filter(F.array(*(F.lit(k) for k in range(1, DEPTH + 1))), lambda k: k <= most)
    return F.transform(depths, lambda k: F.struct(k.alias("depth"), F.xxhash64(F.array_join(F.slice(words, 1, k), " ")).alias("start")))


def _goes_on(ends: DataFrame, texts: DataFrame) -> DataFrame:
    """key, depth, n_on, n_stop: of the longest beginning of an open last line that any other text has, how many sentences go on from it to a full stop, and how many other texts stop open."""
    words = _words(F.col("line"))
    mine = cut(ends.where("kind = 'open'").select("key", F.explode(_beginnings(words, F.size(words) - 1)).alias("b")).select("key", "b.*"))
    stops = mine.groupBy("start").agg(F.count("*").alias("n_stop"))
    wanted = stops.select("start")
    # sentences are reduced to the beginnings that are asked for before anything is exchanged
    full = F.filter(F.split("text", r"(?<=[.!?。！？])[\s\p{Z}]+|[\r\n]+"), lambda x: x.rlike(r"[.!?。！？][\"'”’)\]]*\s*$"))
    starts = texts.select(F.explode(full).alias("s")).select(_words(F.col("s")).alias("w")).select(F.explode(_beginnings(F.col("w"), F.size("w") - 1)).alias("b")).select("b.start")
    asked = F.broadcast(wanted) if wanted.limit(WANTED + 1).count() <= WANTED else wanted
    goes = starts.join(asked, "start", "left_semi").groupBy("start").agg(F.count("*").alias("n_on"))
    seen = mine.join(stops.withColumn("n_stop", F.col("n_stop") - 1), "start").join(goes, "start", "left").withColumn("n_on", F.coalesce("n_on", F.lit(0))).where("n_on + n_stop > 0")
    return seen.groupBy("key").agg(F.max(F.struct("depth", "n_on", "n_stop")).alias("x")).select("key", "x.*")


def _listed(ends: DataFrame) -> DataFrame:
    """Open endings that are lists or tags: key, their last member, and whether it is whole.

    A member is whole if its last word also stands inside such an ending, where nothing can cut it.
    """
    items = F.split(F.regexp_replace("line", r"^[\p{L}\s]{1,20}:\s+", ""), r",\s*")
    sizes = F.transform(items, lambda x: F.size(F.split(x, r"\s+")))
    is_list = (F.size(items) >= 3) & (F.array_max(sizes) <= 3)
    tags = F.regexp_extract_all(F.col("line"), F.lit(r"(#[^\s#]+)"), F.lit(1))
    is_tags = F.col("line").rlike(r"^(?:[^#]*\s)?#[^\s#]+(?:\s+#[^\s#]+)*$")
    df = ends.where("kind = 'open' and not marked").select("key", F.when(is_tags, tags).when(is_list, items).alias("m"), is_tags.alias("tags"), sizes.alias("sizes")).where("m is not null")
    df = df.withColumn("words", F.transform("m", lambda x: F.lower(F.element_at(F.split(x, r"\s+"), -1))))
    inner = df.select(F.explode(F.slice("words", 1, F.size("words") - 1)).alias("last")).groupBy("last").agg(F.count("*").alias("n_inside"))
    df = df.withColumn("last", F.element_at("words", -1)).withColumn("even", F.col("tags") | (F.element_at("sizes", -1) >= F.array_min("sizes")))
    return df.join(inner, "last", "left").where("even and n_inside >= 2").select("key", F.lit(True).alias("listed"))


def _fit(length: np.ndarray, n: np.ndarray, at_limit: np.ndarray) -> tuple[float, float]:
    """Log-normal location and spread of a histogram, right-censored where ``at_limit`` counts: EM."""
    from math import erf, exp, pi, sqrt

    y = np.log(length)
    seen = n - at_limit
    mu = float(np.average(y, weights=n))
    sigma = max(0.05, float(np.sqrt(np.average((y - mu) ** 2, weights=n))))
    where = np.flatnonzero(at_limit > 0)
    for _ in range(100):
        s0, s1, s2 = float(seen.sum()), float((seen * y).sum()), float((seen * y * y).sum())
        for k in where:
            a = (y[k] - mu) / sigma
            tail = max(1e-12, 0.5 * (1 - erf(a / sqrt(2))))
            mills = exp(-0.5 * a * a) / sqrt(2 * pi) / tail
            e1 = mu + sigma * mills
            e2 = mu * mu + 2 * mu * sigma * mills + sigma * sigma * (1 + a * mills)
            c = float(at_limit[k])
            s0, s1, s2 = s0 + c, s1 + c * e1, s2 + c * e2
        new, spread = s1 / s0, max(0.05, (max(1e-6, s2 / s0 - (s1 / s0) ** 2)) ** 0.5)
        done = abs(new - mu) + abs(spread - sigma) < 1e-6
        mu, sigma = new, spread
        if done:
            break
    return mu, sigma


def _limits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Limits of one source and unit, from its histogram of lengths and open endings."""
    pdf = pdf.groupby("length", as_index=False)[["n", "n_open"]].sum().sort_values("length")
    length, n, opened = (pdf[c].to_numpy(dtype="float64") for c in ("length", "n", "n_open"))
    total = n.sum()
    source, unit = pdf.attrs["key"]
    at_limit, found = np.zeros(len(n)), []
    mu, sigma = _fit(length, n, at_limit)
    sums, opens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(opened)])
    share_open = opened.sum() / max(1.0, total)
    while True:
        best = None
        for w in WINDOWS:
            low = np.searchsorted(length, length - w + 1)
            k = np.arange(len(n))
            inside, inside_open = sums[k + 1] - sums[low], opens[k + 1] - opens[low]
            density = np.exp(-0.5 * ((np.log(length) - mu) / sigma) ** 2) / (length * sigma * np.sqrt(2 * np.pi))
            expected = np.maximum(total * density * w, share_open * 0.5)
            z = (inside - expected) / np.sqrt(expected + 1)
            free = np.array([not any(a <= length[j] and length[i] <= b for a, b, *_ in found) for i, j in zip(low, k)])
            # a limit is a pile of texts most of which stop short
            ok = free & (inside >= 6) & (z >= 5) & (inside_open >= 0.5 * inside)
            if ok.any():
                j = int(np.flatnonzero(ok)[z[ok].argmax()])
                if best is None or z[j] > best[0] * 1.15:
                    best = (z[j], length[low[j]], length[j], inside[j], expected[j])
        if best is None:
            break
        _, a, b, count, expected = best
        found.append((a, b, count, expected))
        at_limit += np.where((length >= a) & (length <= b), n, 0.0) * max(0.0, 1 - expected / count)
        at_limit = np.minimum(at_limit, n)
        mu, sigma = _fit(length, n, at_limit)
    rows = []
    for a, b, count, _ in found:
        mid = (a + b) / 2
        expected = total * (b - a + 1) * np.exp(-0.5 * ((np.log(mid) - mu) / sigma) ** 2) / (mid * sigma * np.sqrt(2 * np.pi))
        posterior = float(np.clip(1 - expected / count, 0.01, 0.995))
        over = float(n[length > b].sum())
        rows.append((source, unit, int(a), int(b), posterior, posterior * count / (posterior * count + over), mu, sigma))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in LIMITS.split(", ")])


def _limits_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf.attrs["key"] = key
    return _limits(pdf)


def calibrated(classes: list[tuple[str, float, float]]) -> tuple[dict[str, float], dict[str, float], float, float, str]:
    """(log-odds of each class of endings, its share among cut texts, share of cut texts at limits, share elsewhere, the class that tells).

    ``classes``: (class, texts at limits weighted by their length posterior, texts at none).
    Each side is a mixture of cut and whole texts. By definition a cut text does not end
    with a full sentence or closing sign, and a whole one not inside a character or tag. So
    the full endings at limits tell how many whole texts merely have that length; and cut
    texts elsewhere are as many as the class that whole texts have least leaves room for.
    Fields put a mark after a cut more often, so only classes without one tell.
    Both are iterated until they settle to 1e-9; each step is bounded, and 200 rounds are
    far more than the geometric convergence needs.
    """
    names = [c for c, _, _ in classes]
    pile, off = np.array([w for _, w, _ in classes], float), np.array([n for _, _, n in classes], float)
    full = np.array([c.startswith(("sentence", "symbol")) for c in names])
    torn = np.array([c.startswith("torn") for c in names])
    plain = ~np.array([c.endswith("marked") for c in names])
    free = np.array([c.split()[0] in ("new", "on", "either", "stop") and "said" not in c for c in names])
    prior = np.array([PRIOR.get(c, SMOOTH) for c in names])
    for group, size in ((free & plain, PRIOR["open"]), (free & ~plain, PRIOR["open marked"])):
        prior = np.where(group, size * (off + SMOOTH) / max(SMOOTH, (off + SMOOTH)[group].sum()), prior)
    n_pile, n_off = max(1.0, pile.sum()), max(1.0, off.sum())
    rest, elsewhere, at = 0.0, 0.0, 0

    def of_kind(counts: np.ndarray) -> np.ndarray:
        return counts / np.where(plain, counts[plain].sum() or 1.0, counts.sum())

    share = of_kind(np.where(full, SMOOTH, pile + prior))
    for _ in range(200):
        whole = np.where(torn, 0.0, np.maximum(0.0, off - elsewhere * n_off * share)) + SMOOTH
        whole = whole / whole.sum()
        new_rest = min(0.99, float(pile[full].sum() / n_pile / max(1e-9, whole[full].sum())))
        counts = np.where(full, 0.0, np.maximum(0.0, pile - new_rest * n_pile * whole)) + np.where(torn, off, 0.0) + np.where(full, SMOOTH, prior)
        share = of_kind(counts)
        told = np.flatnonzero((share >= 0.05) & ~full & plain)
        ratio = (off[told] + SMOOTH) / n_off / share[told]
        at = int(told[ratio.argmin()])
        new = float(min(0.5, ratio.min()))
        done = abs(new - elsewhere) + abs(new_rest - rest) < 1e-9
        rest, elsewhere = new_rest, new
        if done:
            break
    return dict(zip(names, np.round(np.log(share / whole), 4).tolist())), dict(zip(names, share.tolist())), 1 - rest, elsewhere, names[at]


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def judged(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every document with its evidence and verdict, the limits found).

    NULL, empty and blank texts and texts without any letter or digit are no cases and
    are left out. A text is judged once a source, and the verdict is that of each of its
    documents. A NULL source is a source of its own. score = length + ending, in log-odds.
    """
    texts = cut(_texts(documents))
    ends = cut(_ends(texts).select("key", "sources", "n_chars", "n_bytes", "marked", "line", "shape", "kind"))
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length"))).alias("units")
    stops = F.col("kind").isin("open", "torn")
    histogram = ends.select(F.explode("sources").alias("source"), units, stops.alias("stops")).select("source", F.explode("units").alias("u"), "stops").groupBy("source", "u.unit", "u.length").agg(F.count("*").alias("n"), F.count_if("stops").alias("n_open"))
    # one row a distinct length: bounded by the longest text, not by the number of texts
    limits = cut(histogram.groupBy("source", "unit").applyInPandas(_limits_of, LIMITS))
    said = ends.where("kind = 'open'").groupBy("shape").agg(F.count("*").alias("n_same")).where("n_same >= 3")
    df = ends.join(_goes_on(ends, texts), "key", "left").join(_listed(ends), "key", "left").join(said, "shape", "left")
    ratio = F.log((F.col("n_on") + SMOOTH) / (F.col("n_stop") + SMOOTH))
    fares = F.when(F.col("depth").isNull(), "new").otherwise(F.concat(F.when(ratio >= 1, "on").when(ratio <= -1.5, "stop").otherwise("either"), F.when(F.col("depth") == 1, " word").otherwise(" words")))
    fares = F.concat(F.when(F.coalesce("listed", F.lit(False)), "listed").otherwise(fares), F.when(F.col("n_same").isNotNull(), " said").otherwise(""))
    ending = F.concat(F.when(F.col("kind") == "open", fares).otherwise(F.col("kind")), F.when(F.col("marked"), " marked").otherwise(""))
    df = df.withColumn("ending", ending).withColumn("source", F.explode("sources"))
    per_source = limits.groupBy("source").agg(F.collect_list(F.struct("unit", "low", "high", "posterior")).alias("limits"))
    df = df.join(per_source, "source", "left")
    hits = lambda unit: F.transform(F.filter(F.coalesce("limits", F.array()), lambda x: (x.unit == unit) & (F.col(f"n_{unit}") >= x.low) & (F.col(f"n_{unit}") <= x.high)), lambda x: x.posterior)
    df = cut(df.withColumn("posterior", F.array_max(F.concat(hits("chars"), hits("bytes")))).select("key", "source", "n_chars", "n_bytes", "kind", "marked", "line", "ending", "posterior"))
    # one row a class of endings: a few dozen, whatever the corpus holds
    each = df.groupBy("key", "ending").agg(F.max("posterior").alias("posterior"))  # a text of several sources counts once
    counts = each.groupBy("ending").agg(F.coalesce(F.sum("posterior"), F.lit(0.0)).alias("w"), F.count_if(F.col("posterior").isNull()).alias("n")).orderBy("ending").collect()
    odds, shares, at_limit, elsewhere, tells = calibrated([(r.ending, r.w, r.n) for r in counts] or [("new", 0.0, 0)])
    # how often each source cuts at no limit, drawn to the rate of all sources by 50 texts' worth
    rates = df.where("posterior is null").groupBy("source").agg(F.count_if(F.col("ending") == tells).alias("k"), F.count("*").alias("n"))
    rates = rates.select("source", F.least(F.lit(0.5), (F.col("k") / shares[tells] + 50 * elsewhere) / (F.col("n") + 50)).alias("rate"))
    df = df.join(rates, "source", "left")
    length = _logit(F.when(F.col("posterior").isNotNull(), F.col("posterior") * at_limit).otherwise(F.greatest(F.coalesce("rate", F.lit(elsewhere)), F.lit(1e-6))))
    table = F.create_map(*(F.lit(x) for pair in odds.items() for x in pair))
    df = df.withColumn("length_odds", F.round(length, 4)).withColumn("ending_odds", F.try_element_at(table, F.col("ending")))
    df = df.withColumn("score", F.round(F.col("length_odds") + F.col("ending_odds"), 3)).withColumn("is_cut", F.col("length_odds") + F.col("ending_odds") > 0)
    copies = documents.where("doc_id is not null and text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), _key(F.col("text")).alias("key"))
    return copies.join(df, ["key", "source"]).select("doc_id", "source", "n_chars", "n_bytes", "kind", "marked", "line", "ending", "posterior", "length_odds", "ending_odds", "score", "is_cut"), limits


def found(documents: DataFrame) -> DataFrame:
    return judged(documents)[0].where("is_cut").select("doc_id").distinct()


def by_source(documents: DataFrame) -> DataFrame:
    """source, texts, cut_texts, share, limits: how often each source cuts, and where."""
    rows, limits = judged(documents)
    counts = rows.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("is_cut").alias("cut_texts"))
    where = limits.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("high").cast("string"), "unit"))), ", ").alias("limits"))
    return counts.join(where, "source", "left").withColumn("share", F.round(F.col("cut_texts") / F.col("texts"), 4))
