"""Text expressions against plain Python twins."""

import unicodedata

from pyspark.sql import functions as F

from cairn.functions import text as T

SPACE = set("\t\n\x0b\x0c\r \x85") | {chr(c) for c in range(0x3100) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp")}
CASES = ["", " ", "a b", "Wörld_x  $5.00—ok", "ΣΑΣ İx Ⓐ", "Don't  stop!", "x y z", "日本語 text。", "One. Two three four five six.Seven eight nine ten.\n\nNew paragraph without stop", "a" * 5000 + " b", "A first sentence of size! Is this a second? Yes it is a third one."]


def tokens(s):
    out, word = [], ""
    for c in s:
        kind = unicodedata.category(c)[0]
        if c in SPACE or kind in "PS":
            if word:
                out.append(word)
            word = ""
            if kind in "PS":
                out.append(c)
        else:
            low = c.lower()
            word += low if len(low) == 1 else "i"
    return out + ([word] if word else [])


def cut(s):
    out, part = [], ""

    def add():
        t = part.strip("".join(SPACE))
        if len(t.encode()) > 15:
            out.append(t)

    for i, c in enumerate(s):
        part += c
        after = s[i + 1] if i + 1 < len(s) else None
        if (c in ".!?" and (after is None or after in SPACE or unicodedata.category(after) == "Lu")) or (c == "\n" and after == "\n"):
            add()
            part = ""
    add()
    return out


def test_twins(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, t string").select("i", T.pre_tokens(F.col("t")).alias("p"), T.sentences(F.col("t")).alias("s"), T.is_blank(F.col("t")).alias("b"))
    for r in df.collect():
        assert r["p"] == tokens(CASES[r["i"]]), CASES[r["i"]]
        assert r["s"] == cut(CASES[r["i"]]), CASES[r["i"]]
        assert r["b"] == (not CASES[r["i"]].strip("".join(SPACE)))


def test_small_functions(spark):
    row = spark.range(1).select(
        T.title_of(F.lit("/a/b.c/x.tar.md")).alias("title"), T.title_of(F.lit("/a/.md")).alias("none"), T.extension_of(F.lit("/a/X.MD")).alias("ext"), T.word_wrap(F.lit("aa bb ccccccc d"), 5).alias("w"),
        T.word_wrap(F.lit(" "), 5).alias("w0"), T.shorten(F.lit("é" * 600), 500).alias("short"), T.bag_words(F.lit("An owl, an OWL at 10 日本")).alias("bag"), T.symbols(F.lit("aéb")).alias("sym"), T.pre_tokens(F.lit(None).cast("string")).alias("null"),
    ).first()
    assert (row["title"], row["none"], row["ext"]) == ("x.tar", "", ".md")
    assert row["w"] == ["aa bb", "ccccccc", "d"] and row["w0"] == []
    assert row["short"] == "é" * 500 + "..." and row["bag"] == ["owl", "owl", "日本"] and row["sym"] == ["a", "é", "b"] and row["null"] is None
