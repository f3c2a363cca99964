"""One consistent form for text that looks the same but differs in its characters.

Text is exploded to positioned code points (a run of ASCII that no mark follows stays one piece: it is its own form), the
broadcast mapping gives each its decomposition, plain letter or nothing, marks are ordered by class behind their starter,
clusters are recomposed by a second broadcast table, and the string is rebuilt in order of position.

Rows that repeat an id with the same text count once. Null text gives a null form, empty text the empty form. Texts are
taken whole; only pieces of one text are ever gathered in a task.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexisift.session import written

#: Letters of other scripts that look like a Latin letter, by that letter (fixed values).
LETTERS = {
    "a": "аɑα", "c": "сϲᴄ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іıɩι", "j": "јϳյ", "k": "", "l": "ӏǀ", "n": "ո", "o": "оοօᴏ", "p": "рρ", "q": "ԛզ", "s": "ѕꜱ",
    "u": "սυᴜ", "v": "ѵνᴠ", "w": "ԝᴡ", "x": "х", "y": "уү", "z": "ᴢ",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "ꓝϜ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀꓲ", "J": "ЈᎫꓙͿ", "K": "КΚᏦꓗ", "L": "Ꮮꓡ", "M": "МΜᎷꓟ", "N": "Νꓠ",
    "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "УΥҮᎩꓬ", "Z": "ΖᏃꓜ",
}
HYPHENS = "‐‑﹣－˗"
#: Invisible though not of category Cf (fixed values).
INVISIBLE = (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")


@lru_cache(1)
def mapping() -> dict[int, str]:
    """Code point -> what it stands for; others stand for themselves. The size is bounded by Unicode."""
    to_plain = {ord(x): plain for plain, group in LETTERS.items() for x in group}
    hidden = set(INVISIBLE)
    out: dict[int, str] = {}

    def expand(o: int) -> str:
        c = chr(o)
        if o in to_plain:
            return to_plain[o]
        if o in hidden or (o > 127 and unicodedata.category(c) == "Cf"):
            return ""
        if unicodedata.category(c) == "Zs":
            return " "
        if c in HYPHENS:
            return "-"
        d = unicodedata.decomposition(c)
        if not d:
            return c
        tag, _, rest = d.rpartition(">")
        parts = [int(x, 16) for x in rest.split()]
        if tag:
            tag += ">"
            if tag not in _TAGS or (0x20 in parts and len(parts) > 1):
                return c
        return "".join(map(expand, parts))

    for o in range(0x80, 0x110000):
        if 0xAC00 <= o < 0xD7A4:
            out[o] = unicodedata.normalize("NFD", chr(o))
        elif not 0xD800 <= o < 0xE000 and (got := expand(o)) != chr(o):
            out[o] = got
    return out


@lru_cache(1)
def compositions() -> list[tuple[str, str]]:
    """Decomposed cluster -> composed character."""
    out = []
    for o in range(0x80, 0x30000):
        c = chr(o)
        if not 0xD800 <= o < 0xE000 and not unicodedata.decomposition(c).startswith("<") and unicodedata.normalize("NFC", c) == c:
            d = unicodedata.normalize("NFD", c)
            if d != c and not 0xAC00 <= o < 0xD7A4:
                out.append((d, c))
    return out


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    maps = [(o, [(x, unicodedata.combining(x)) for x in to]) for o, to in mapping().items()]
    marks = [(o, [(chr(o), unicodedata.combining(chr(o)))]) for o in range(0x300, 0x1E94B) if unicodedata.combining(chr(o)) and o not in mapping()]
    m = spark.createDataFrame(maps + marks, "cp int, parts array<struct<piece:string,ccc:int>>")
    return m, spark.createDataFrame(compositions(), "cluster string, composed string")


#: ASCII runs without the last character if what follows isn't ASCII; else one code point.
PIECES = r"[\x00-\x7f]+(?![^\x00-\x7f])|[\x00-\x7f]+?(?=[\x00-\x7f][^\x00-\x7f])|(?s:.)"


def consistent_form(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, content, form) of each distinct (id, text). A text that is all ASCII is its own form and isn't exploded."""
    spark = df.sparkSession
    maps, comps = _tables(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("content")).distinct().withColumn("n", F.xxhash64("id", "content"))
    odd = F.coalesce(F.col("content").rlike("[^\\x00-\\x7f]"), F.lit(False))
    plain = rows.filter(~odd).select("id", "content", F.col("content").alias("form"))
    work = rows.filter(odd)
    points = work.repartition("id", "n").select("id", "n", F.posexplode(F.regexp_extract_all("content", F.lit(PIECES), F.lit(0))).alias("pos", "piece"))
    points = points.withColumn("cp", F.when((F.char_length("piece") == 1) & (F.ascii("piece") > 127), F.ascii("piece")))
    mapped = points.join(F.broadcast(maps), "cp", "left")
    own = F.array(F.struct(F.col("piece"), F.lit(0).alias("ccc")))
    # an inlined explode of nothing would lose a text of invisible characters: the empty piece keeps its row
    none = F.array(F.struct(F.lit("").alias("piece"), F.lit(0).alias("ccc")))
    parts = F.when(F.col("parts").isNull(), own).when(F.size("parts") == 0, none).otherwise(F.col("parts"))
    flat = mapped.select("id", "n", "pos", F.posexplode(parts).alias("sub", "part")).select("id", "n", "pos", "sub", "part.piece", "part.ccc")
    order = Window.partitionBy("id", "n").orderBy("pos", "sub")
    # an invisible character is nothing: it opens no cluster, so marks behind it join the starter before it
    starts = F.when((F.col("ccc") == 0) & (F.col("piece") != ""), 1).otherwise(0)
    clustered = flat.withColumn("seg", F.sum(starts).over(order))
    clusters = clustered.groupBy("id", "n", "seg").agg(F.sort_array(F.collect_list(F.struct("ccc", "pos", "sub", "piece"))).alias("p"), F.max("ccc").alias("marks"))
    text_of = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    clusters = clusters.select("id", "n", "seg", text_of.alias("cluster"), F.when(F.col("marks") > 0, text_of).alias("key"))
    joined = clusters.join(F.broadcast(comps.withColumnRenamed("cluster", "key")), "key", "left")
    rebuilt = joined.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("seg", F.coalesce("composed", "cluster").alias("t")))).alias("all"))
    forms = rebuilt.select("id", "n", F.array_join(F.transform("all", lambda x: x["t"]), "").alias("form"))
    return plain.unionByName(work.join(forms, ["id", "n"]).select("id", "content", "form"))


def classes(forms: DataFrame) -> DataFrame:
    """(id, class, content_class, n_contents, n_ids): every id whose form another content has too. class names the form,
    content_class the content: ids of one class and different content_class are links, none of which is lost or listed twice."""
    keyed = forms.filter("id is not null and form is not null").select("id", F.sha2("form", 256).alias("class"), F.sha2("content", 256).alias("content_class"))
    keyed = written(keyed.distinct(), "classes")
    sizes = keyed.groupBy("class", "content_class").agg(F.count("*").alias("n")).groupBy("class").agg(F.count("*").alias("n_contents"), F.sum("n").alias("n_ids")).filter("n_contents > 1")
    return keyed.join(sizes, "class")


def equal_looking_pairs(forms: DataFrame) -> DataFrame:
    """(a, b), a < b by code point: ids whose contents differ and whose forms agree.

    The pairs of differing contents are made between one representative each and only then carried to the ids, so copies of
    one content aren't compared with each other.
    """
    keyed = forms.filter("id is not null and form is not null").select("id", F.sha2("form", 256).alias("f"), F.sha2("content", 256).alias("c"))
    keyed = written(keyed, "forms")  # used several times: the forms are made once
    classes = keyed.groupBy("f", "c").agg(F.count("*").alias("n"))
    several = classes.groupBy("f").agg(F.count("*").alias("k")).filter("k > 1").select("f")
    keyed = keyed.join(several, "f", "left_semi").distinct()
    kinds = keyed.select("f", "c").distinct()
    links = kinds.alias("x").join(kinds.alias("y"), (F.col("x.f") == F.col("y.f")) & (F.col("x.c") != F.col("y.c"))).select(F.col("x.f").alias("f"), F.col("x.c").alias("c"), F.col("y.c").alias("d"))
    left = links.join(keyed.withColumnRenamed("id", "a"), ["f", "c"])
    both = left.join(keyed.select("f", F.col("c").alias("d"), F.col("id").alias("b")), ["f", "d"])
    return both.filter("a < b").select("a", "b").distinct()


def form_of(text: str | None) -> str | None:
    """The same form in plain Python, for tests."""
    if text is None:
        return None
    m = mapping()
    d = "".join(m.get(ord(c), c) for c in text)
    out, at = [], 0
    while at < len(d):
        end = at + 1
        while end < len(d) and unicodedata.combining(d[end]):
            end += 1
        cluster = "".join(sorted(d[at:end], key=unicodedata.combining))
        out.append(_COMPOSED().get(cluster, cluster) if end - at > 1 or unicodedata.combining(d[at]) else cluster)
        at = end
    return "".join(out)


@lru_cache(1)
def _COMPOSED() -> dict[str, str]:
    return dict(compositions())
