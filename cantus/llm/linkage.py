"""Problem 5: the same recording in two sources without a common key.

Collective graph linkage. Every row is read in each way its fields allow (artist in
the title, fields swapped, names in either script), and each reading gives blocking
attributes that are rare by construction: artist with title, title with artist, both
tolerant of one slip of the pen, and artist, length and the start of the title. Rows
that share attributes are candidate edges, weighted by the rarity of what they share.
Meta-blocking keeps the edges that are strong for one of their rows. Edge confidences
then start from the compared fields and the rarity, and are refined by what their
neighbours say until they settle: other edges between the same two artists prove that
two spellings are one artist and make up for what the names lack, and a better rival
of the same row speaks against an edge. Equal rows are compared once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantus.plans.storage import cut, release

# The Revised Romanization of Korean, letter by letter.
INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h".replace("-", "").split(" ")
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
FINALS = ["", *"k k k n n n t l k m p l l p l m p p t t ng t t k t p t".split()]

NOISE = r"(?:official|music|video|audio|lyrics?|mv|m/v|visuali[sz]er|performance|hd|hq|4k|clip|full|clean|explicit|topic)"
VERSIONS = {"live": r"live(?:\s+(?:ver(?:sion)?\.?|at\b.*|in\b.*|session.*|clip))?", "acoustic": r"acoustic(?:\s+(?:ver(?:sion)?\.?|session|mix))?", "remix": r"(?:[\w\s&.']+\s+)?(?:remix|rmx)(?:\s+ver(?:sion)?\.?)?", "instrumental": r"(?:inst(?:rumental)?\.?|karaoke|mr)(?:\s+ver(?:sion)?\.?)?", "demo": r"demo(?:\s+(?:ver(?:sion)?\.?|take|tape))?"}
OPEN, CLOSE = r"[(\[{「『【<]", r"[)\]}」』】>]"
READING = "row_id string, reading int, artist string, title string, base string, artist_own string, title_own string, short boolean, version string, seconds double, album string, keys array<string>"


def roman(text: str) -> str:
    """Hangul syllables by their letters; everything else unchanged."""
    out = []
    for ch in unicodedata.normalize("NFC", text):
        n = ord(ch) - 0xAC00
        out.append(INITIALS[n // 588] + VOWELS[n % 588 // 28] + FINALS[n % 28] if 0 <= n < 11172 else ch)
    return "".join(out)


def squeeze(text: str | None, latin: bool = True, drop: tuple[str, ...] = ()) -> str:
    """Letters and digits only, in lower case, without accents and spaces, in Latin script unless told otherwise."""
    if not text:
        return ""
    text = unicodedata.normalize("NFKC", text)
    text = roman(text) if latin else text
    text = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))).casefold()
    text = re.sub(r"['’`]", "", text.replace("&", " and ").replace("+", " and "))
    return "".join(w for w in re.findall(r"[^\W_]+", text) if w not in drop)


def artist_key(text: str | None, latin: bool = True) -> str:
    """An artist's name without what channels add to it, articles and the spelling of 'and'."""
    if not text:
        return ""
    text = re.sub(rf"\s*{OPEN}\s*(?:band|official|{NOISE})\s*{CLOSE}|\s+-\s+topic\s*$|\s+official\s*$", "", text.strip(), flags=re.I)
    text = re.sub(r"\s*[(\[]?\b(?:feat|ft|featuring)\b\.?.*$", "", text, flags=re.I)
    return squeeze(text, latin, ("the", "and"))


def undress(title: str) -> tuple[str, str]:
    """(title without decorations and guests, version)."""
    t, before, version = unicodedata.normalize("NFKC", title).replace("...", "…").strip(), None, set()
    while t != before:
        before = t
        t = re.sub(rf"{OPEN}\s*(?:{NOISE}[\s/.-]*)+{CLOSE}", " ", t, flags=re.I)
        t = re.sub(rf"\s*\|\s*(?:{NOISE}\s*)+$|\bM/V(?=\s|$)|\s+official\s+(?:{NOISE}\s*)+$", " ", t, flags=re.I)
        t = re.sub(rf"{OPEN}\s*(?:feat|ft|featuring|with)\b\.?\s[^)\]}}」]*{CLOSE}", " ", t, flags=re.I)
        t = re.sub(r"\s(?:feat|ft|featuring)\b\.?\s.*$", " ", t, flags=re.I)
        for name, pattern in VERSIONS.items():
            for where in (rf"{OPEN}\s*{pattern}\s*{CLOSE}", rf"\s+[-–—~|]\s+{pattern}\s*(?=$|{OPEN}|\s[-–—]\s)"):
                if re.search(where, t, flags=re.I):
                    version.add(name)
                    t = re.sub(where, " ", t, flags=re.I)
        t = re.sub(r"\s+", " ", t).strip()
    return t, "+".join(sorted(version))


def readings(title: str | None, artist: str | None) -> list[dict]:
    """Artist and title keys in every way the two fields can be read."""
    raw, version = undress(title or "")
    other, swapped_version = undress(artist or "")
    pairs = [(artist or "", raw, version)]
    pairs.append((raw, other, "+".join(sorted({*version.split("+"), *swapped_version.split("+")} - {""}))))  # fields swapped
    m = re.match(r"^(.*?)\s*[「『]\s*(.*?)\s*[」』]\s*$", raw)
    if m:
        inner, inner_version = undress(m[2])
        pairs.append((m[1], inner, version or inner_version))
    for sign in (r"\s+[-–—]\s+", r"\s*:\s+", r"\s+_\s+", r"\s+\|\s+"):
        for cutting in re.finditer(sign, raw):
            left, right = raw[: cutting.start()], raw[cutting.end() :]
            pairs += [(left, right, version), (right, left, version)]
    out: list[dict] = []
    for a, t, v in pairs:
        short = bool(re.search(r"…\s*$", t))
        r = {"artist": artist_key(a), "title": squeeze(t), "base": squeeze(re.sub(rf"\s*{OPEN}.*$", "", t)), "artist_own": artist_key(a, False), "title_own": squeeze(t, False), "short": short, "version": v}
        if r["title"] and r["artist"] and r not in out:
            out.append(r)
    return out


def seconds(ms) -> float | None:
    """Length in seconds; a number too small for milliseconds is taken as seconds."""
    if ms is None or ms != ms or ms <= 0:
        return None
    return float(ms) if ms < 10_000 else ms / 1000.0


def _deletions(s: str) -> set[str]:
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))} if len(s) >= 4 else {s}


def album_key(album: str | None) -> str:
    return squeeze(re.sub(r"\s*(?:[(\[][^)\]]*(?:deluxe|edition|remaster)[^)\]]*[)\]]|\s-\s(?:EP|Single))\s*$", "", album, flags=re.I)) if album else ""


def _starts(a: str, t: str, v: str, short: bool, side: str) -> set[str]:
    """Keys by which a title cut short meets those that begin like it; two whole titles share none of them."""
    other = "r" if side == "l" else "l"
    if not short:
        return {f"p{side}|{a}|{t[:n]}|{v}" for n in range(3, 9)}
    return {f"p{other}|{a}|{t[:8]}|{v}"} | {f"ps|{a}|{t[:n]}|{v}" for n in range(3, 9)}


def _reader(side: str):
    return lambda batches: _read(batches, side)


def _read(batches: Iterator[pd.DataFrame], side: str) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row_id, title, artist, album, ms in zip(pdf["row_id"], pdf["title"], pdf["artist"], pdf["album"], pdf["duration_ms"]):
            length = seconds(ms)
            near = [] if length is None else sorted({int((length + d) // 4) for d in (-1.9, 1.9)})
            for k, r in enumerate(readings(title, artist)):
                a, t, v = r["artist"], r["title"], r["version"]
                keys = {f"at|{a}|{x}|{v}" for x in _deletions(t) | _deletions(r["title_own"])} | {f"ta|{t}|{x}|{v}" for x in _deletions(a) | _deletions(r["artist_own"])}
                keys |= {f"s|{a}|{t[:4]}|{n}|{v}" for n in near} | {f"x|{t}|{n}|{x}|{v}" for n in near for x in {a[:4], a[-4:]}} | {f"b|{a}|{r['base']}|{v}"}
                keys |= _starts(a, t, v, r["short"], side)
                out.append((row_id, k, *(r[c] for c in ("artist", "title", "base", "artist_own", "title_own", "short", "version")), length, album_key(album), sorted(keys)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in READING.split(", ")])


def slips(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance: insertions, deletions, changes, swaps of neighbours; ``most`` + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
        if min(row) > most:
            return most + 1
    return last[-1]


def alike(a: str, b: str) -> float:
    """1 for equal names, less for one or two slips in a long name, 0 beyond; differing numbers are different names."""
    if a == b:
        return 1.0
    if re.findall(r"\d+", a) != re.findall(r"\d+", b):
        return 0.0
    d, n = slips(a, b), min(len(a), len(b))
    return 0.9 if d == 1 and n >= 5 else 0.75 if d == 2 and n >= 10 else 0.0


def compared(a: dict, b: dict) -> tuple[float, float, float, float]:
    """Title, artist, length and album evidence of two readings."""
    title = max(alike(a["title"], b["title"]), alike(a["title_own"], b["title_own"]))
    for x, y in ((a, b), (b, a)):
        if x["short"] and y["title"].startswith(x["title"]):
            title = max(title, 0.92)
    if title < 0.8 and a["base"] == b["base"] and (a["title"] == a["base"]) != (b["title"] == b["base"]):
        title = max(title, 0.7)  # one side leaves the bracket out
    artist = max(alike(a["artist"], b["artist"]), alike(a["artist_own"], b["artist_own"]))
    x, y = a["seconds"], b["seconds"]
    gap = None if x is None or y is None or x != x or y != y else abs(x - y)
    length = 0.0 if gap is None else 1.0 if gap <= 3.5 else 0.3 if gap <= 6 else -1.0
    album = 0.0 if not a["album"] or not b["album"] else 1.0 if alike(a["album"], b["album"]) else -0.2
    return title, artist, length, album


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.to_dict("records"):
            pick = lambda p: {k: r[f"{p}_{k}"] for k in ("artist", "title", "base", "artist_own", "title_own", "short", "seconds", "album")}  # noqa: B023,E731
            t, a, length, album = compared(pick("l"), pick("r"))
            if not t or not a:
                continue
            # exact names carry a match alone unless length and album both speak against it; inexact ones need support
            base = 0.72 - 2.2 * (1 - t) - 1.0 * (1 - a) + 0.2 * length + 0.12 * album + RARITY * (float(r["rarity"]) - 0.9)
            out.append((r["left_id"], r["right_id"], r["l_artist"], r["r_artist"], float(r["weight"]), float(min(0.99, base)), float(1 - a)))
        yield pd.DataFrame(out, columns=["left_id", "right_id", "left_artist", "right_artist", "weight", "base", "doubt"])


def joined(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Join of two tables that grow with the input: never broadcast, whatever their files are estimated at (they compress tenfold, and a broadcast passes through the driver)."""
    return a.join(b.hint("merge"), on)


RARITY, AROUND, RIVAL = 0.2, 0.1, 0.2
SETTLED, MOST_ROUNDS = 1e-5, 200


def refined(scored: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """Edges with their confidences moved by their neighbours' until no confidence moves by ``SETTLED``.

    The artists' edges move a confidence by at most ``doubt`` + AROUND (doubt is at most
    0.25) and rivals by 2 * RIVAL of their own moves, 0.75 together, so a round leaves
    at most three quarters of a difference, and MOST_ROUNDS are never reached; if they
    were, that is an error and not a result. Fewer ``rounds`` are for comparison only.
    """
    moved = None
    for _ in range(rounds):
        # what the other edges between the same two artists say, as the mean confidence around this edge
        artists = scored.groupBy("left_artist", "right_artist").agg(F.sum("confidence").alias("all"), F.count("*").alias("n"))
        rivals = scored.groupBy("right_id").agg(F.max("confidence").alias("top"))
        around = F.when(F.col("n") > 1, (F.col("all") - F.col("confidence")) / (F.col("n") - 1)).otherwise(0.5)
        proof = F.when(F.col("n") > 1, around * F.least(F.lit(1.0), (F.col("n") - 1) / 2)).otherwise(0.0)
        own = F.col("base") + F.col("doubt") * proof + AROUND * (around - 0.5) * F.least(F.lit(1.0), (F.col("n") - 1) / 3)
        after = own - RIVAL * (F.col("top") - F.col("confidence"))  # a better rival of the same row speaks against it
        held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(after, 6)))
        step = joined(joined(scored, artists, ["left_artist", "right_artist"]), rivals, "right_id")
        step = cut(step.select("left_id", "right_id", "left_artist", "right_artist", "weight", "base", "doubt", held.alias("confidence"), F.abs(held - F.col("confidence")).alias("moved")))
        moved = step.agg(F.max("moved")).first()[0]
        release(scored)
        scored = step
        if moved is None or moved < SETTLED:
            return scored.drop("moved")
    if rounds == MOST_ROUNDS:
        raise RuntimeError(f"the confidences did not settle in {rounds} rounds: one still moves by {moved}")
    return scored.drop("moved")


def link(left: DataFrame, right: DataFrame, least: float = 0.4, keep: float = 0.3, rounds: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(matches: left_id, right_id, confidence; all scored edges between representatives of equal rows).

    Both sides have (row_id, title, artist, album, duration_ms). Rows equal in all fields
    but the id are compared once and share their matches. A row without a title or
    artist in any reading matches nothing; missing albums and lengths are no evidence.
    Versions (live, acoustic, remix, instrumental, demo) must agree. A right row keeps
    its best left row and the left rows equal to that; a left row may have several right
    rows. Of equally good left rows one is kept by a hash of its id.
    """
    fields = ["title", "artist", "album", "duration_ms"]

    def copies(df: DataFrame) -> DataFrame:
        """row_id, like: every id with the smallest id of equal rows."""
        df = df.select("row_id", "title", "artist", "album", F.col("duration_ms").cast("double").alias("duration_ms")).where("row_id is not null").distinct()
        first = df.groupBy(*fields).agg(F.min("row_id").alias("like"))
        same = F.lit(True)
        for c in fields:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return cut(joined(df.alias("a"), first.alias("b"), same).select("a.row_id", "b.like", *(f"a.{c}" for c in fields)))

    left_rows, right_rows = copies(left), copies(right)
    read = lambda df, side: cut(df.select(F.col("like").alias("row_id"), *fields).distinct().mapInPandas(_reader(side), READING))
    lefts, rights = read(left_rows, "l"), read(right_rows, "r")
    keyed = lambda df, p: df.select(F.col("row_id").alias(f"{p}_id"), F.col("reading").alias(f"{p}_reading"), F.explode("keys").alias("key"))
    lk, rk = keyed(lefts, "left"), keyed(rights, "right")
    # rarity of an attribute: how many left rows have it, as a share of all
    rarity = lk.groupBy("key").agg(F.countDistinct("left_id").alias("n"))
    total = lefts.agg(F.countDistinct("row_id").alias("total"))  # one row
    shared = joined(joined(lk, rk, "key"), rarity, "key").crossJoin(F.broadcast(total))
    weight = F.sum(F.log((F.col("total") + 1) / F.col("n")))
    edges = cut(shared.groupBy("left_id", "right_id", "left_reading", "right_reading").agg(weight.alias("weight"), (weight / (weight + F.log(F.max("total") + 1))).alias("rarity")))
    best_l = edges.groupBy("left_id").agg(F.max("weight").alias("top_l"))
    best_r = edges.groupBy("right_id").agg(F.max("weight").alias("top_r"))
    strong = joined(joined(edges, best_l, "left_id"), best_r, "right_id").where((F.col("weight") >= keep * F.col("top_l")) | (F.col("weight") >= keep * F.col("top_r")))
    names = ("artist", "title", "base", "artist_own", "title_own", "short", "seconds", "album")
    l = lefts.select(F.col("row_id").alias("left_id"), F.col("reading").alias("left_reading"), *(F.col(c).alias(f"l_{c}") for c in names))  # noqa: E741
    r = rights.select(F.col("row_id").alias("right_id"), F.col("reading").alias("right_reading"), *(F.col(c).alias(f"r_{c}") for c in names))
    scored = joined(joined(strong, l, ["left_id", "left_reading"]), r, ["right_id", "right_reading"]).mapInPandas(_score, "left_id string, right_id string, left_artist string, right_artist string, weight double, base double, doubt double")
    one = F.max_by(F.struct("left_artist", "right_artist", "weight", "base", "doubt"), F.struct("base", "weight", "left_artist", "right_artist")).alias("e")
    scored = cut(scored.groupBy("left_id", "right_id").agg(one).select("left_id", "right_id", "e.*").withColumn("confidence", F.greatest(F.lit(0.0), F.col("base"))))
    release(edges)
    scored = refined(scored, rounds)
    best = scored.groupBy("right_id").agg(F.max_by(F.struct("left_id", "confidence"), F.struct("confidence", "base", "weight", F.xxhash64("left_id"))).alias("b"))
    matches = best.select(F.col("b.left_id").alias("l_like"), F.col("right_id").alias("r_like"), F.round("b.confidence", 4).alias("confidence")).where(F.col("confidence") >= least)
    ids = lambda df, p: df.select(F.col("row_id").alias(f"{p}_id"), F.col("like").alias(f"{p[0]}_like")).distinct()
    found = joined(joined(matches, ids(left_rows, "left"), "l_like"), ids(right_rows, "right"), "r_like")
    return found.groupBy("left_id", "right_id").agg(F.max("confidence").alias("confidence")), scored


def same_recordings(indie: DataFrame, liked: DataFrame) -> DataFrame:
    """track_id, liked_id, confidence."""
    cols = ("title", "artist", "album", "duration_ms")
    matches, _ = link(indie.select(F.col("track_id").alias("row_id"), *cols), liked.select(F.col("liked_id").alias("row_id"), *cols))
    return matches.select(F.col("left_id").alias("track_id"), F.col("right_id").alias("liked_id"), "confidence")
