"""Subject areas of documents (problem 10): labelling functions under an accuracy-learning latent model.

The unit is the sentence. Labelling functions vote on its subject or abstain, each on evidence of its own:

* lexicon - the terms of the sentence, by a learned table of term and subject;
* section - the other sentences of its paragraph, or else of its document, if one subject holds more than half of them;
* address - the words of the document's folder and path, by a table learned from hand labels and the subjects' descriptions;
* source - the same for the name of its source.

The lexicon starts from hand labels (a bounded sample of labelled documents) and is then counted over all documents: a term
counts for a subject in each document where it stands in a sentence whose *other* known terms agree on that subject. Terms
enter if their subjects differ from the usual mix beyond chance and three subjects hold nearly all of them, so a word of
several fields stays in with its odds while names and the words of every text stay out. It holds for all languages at once.
The tables of addresses and sources have the same test; where names tell nothing of subjects they stay empty and abstain.

How far each function is to be trusted is learned without labels: expectation maximisation of a latent-class model (one
accuracy per function, votes independent given the subject) over the counts of all vote patterns. Each sentence gets its
posterior subject, limited to the subjects of its terms; a document has every subject to which at least ``SHARE`` of its
sentences on any subject belong.

Texts are read once, into 64-bit hashes of terms; everything after that works on whole batches of numbers.

Defined results: null and empty texts, and texts without a known term, have no subject; labels that are null, of unknown
subjects or documents, or repeated count nothing or once; letter case, surrounding spaces and Unicode forms do not matter;
rows with a null id are left out, of several texts under one id the first in byte order holds; without labels or subjects
there are no rows; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize

SHARE = 0.2
#: Labelled documents that start the lexicon, rounds of counting over all documents, and terms that the model may hold (the
#: most telling ones; like any vocabulary size it bounds what every task carries).
LABELLED, ROUNDS, LEXICON = 20_000, 3, 200_000
#: A term that stands in more of a language's documents than this times 1 / number of subjects (half of them at most), by
#: more than ``SPREAD`` standard deviations, is no term of a subject.
COMMON, SPREAD = 1.35, 3.0
_G_MIN, _TOP3 = 12.0, 0.85
SEED_DOCS, SEED_G = 1.5, 2.5
SEED = 42  # of the hash; the same as in the SQL function xxhash64
TERMS_AT_ONCE = 500_000

# Three-letter codes of languages that also have one of two letters.
LANGUAGES = {"eng": "en", "spa": "es", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl", "rus": "ru", "zho": "zh", "chi": "zh", "jpn": "ja"}

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_HIDDEN = re.compile("[\u200b-\u200f\u00ad\u2060\ufeff]")
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile("(?<=[.!?\u3002])[\\s\u200b]+|\\n+")


class _Hashes(dict):
    """Hash by word; forgets everything rather than grow without bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode(), SEED)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def sentences_of(text: str) -> Iterator[tuple[int, list[str]]]:
    """(number of the paragraph, distinct terms) of every sentence with a term."""
    text = unicodedata.normalize("NFKC", text.replace("\r\n", "\n").replace("\r", "\n").replace("\u200b", " "))
    for k, par in enumerate(_PARAGRAPH.split(_HIDDEN.sub("", text).casefold())):
        for s in _SENTENCE.split(par):
            terms = _WORD.findall(s)
            if terms:
                yield k, list(dict.fromkeys(terms))


def _name_words(*names: Column) -> Column:
    """Hashes of the distinct words of some names."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *names)), F.lit(r"\p{L}+"), F.lit(0))
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def _language(lang: Column) -> Column:
    code = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.when(~code.isin("", "und", "mul", "zxx", "mis"), F.coalesce(F.try_element_at(known, code), code))


def read_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", address_col: str = "root_dir", source_col: str = "source", lang_col: str = "lang", path_col: str = "path") -> DataFrame:
    """(id, address, source, lang, ids, sizes, pars): hashes of the names' words, and of all terms sentence by sentence with
    the number of terms and the paragraph of each sentence. A written table."""
    rows = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    where = [F.col(c).cast("string") for c in (address_col, path_col) if c in documents.columns]
    key = F.lower(F.regexp_replace(F.col(source_col), r"[^\p{L}\p{Nd}]", ""))
    source = F.array_union(_name_words(F.col(source_col)), F.when(key != "", F.array(F.xxhash64(F.concat(F.lit("source:"), key)))).otherwise(F.array().cast("array<bigint>")))
    best = F.min(F.struct(F.col(text_col).alias("text"), _name_words(*where).alias("address"), F.coalesce(source, F.array().cast("array<bigint>")).alias("source"), _language(F.col(lang_col)).alias("lang"))).alias("m")
    one = rows.groupBy(F.col(id_col).alias("id")).agg(best).select("id", "m.*")
    kind = dict(one.dtypes)["id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            ids, sizes, pars, of_ids, of_sizes = [], [], [], [0], [0]
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                for par, terms in sentences_of(text):
                    ids += [known[w] for w in terms]
                    sizes.append(len(terms))
                    pars.append(par)
                of_ids.append(len(ids)), of_sizes.append(len(sizes))
            lists = lambda values, ends, kind: pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(values, dtype=kind)))
            rest = [b.column(b.schema.get_field_index(c)) for c in ("id", "address", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*rest, lists(ids, of_ids, np.int64), lists(sizes, of_sizes, np.int32), lists(pars, of_sizes, np.int32)], names=["id", "address", "source", "lang", "ids", "sizes", "pars"])

    return materialize(one.mapInArrow(read, f"id {kind}, address array<bigint>, source array<bigint>, lang string, ids array<bigint>, sizes array<int>, pars array<int>"), "terms")


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a column of lists."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``TERMS_AT_ONCE`` terms."""
    if not batch.num_rows:
        return
    ends = np.cumsum(_flat(batch, "ids")[1])
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + TERMS_AT_ONCE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _sure(score: np.ndarray, margin: float = 1.1) -> np.ndarray:
    """Per row the subject that leads by ``margin`` nats, or -1."""
    if not score.shape[1]:
        return np.full(len(score), -1)
    first = score.argmax(axis=1)
    top = np.take_along_axis(score, first[:, None], axis=1)[:, 0]
    if score.shape[1] < 2:
        return np.where(top > -np.inf, first, -1)
    rest = score.copy()
    np.put_along_axis(rest, first[:, None], -np.inf, axis=1)
    return np.where((top - rest.max(axis=1) >= margin) & (top > 0), first, -1)


class Lexicon:
    """Odds of the subjects by term: row i of ``p`` for the hash ``keys[i]``, smoothed; ``log`` relative to the prior."""

    def __init__(self, subjects: list[str], counts: dict[int, np.ndarray], prior: np.ndarray, names: Callable | None = None):
        self.subjects, self.prior, self._names = subjects, prior, names
        self.keys = np.array(sorted(counts), dtype=np.int64)
        c = np.array([counts[w] for w in sorted(counts)]).reshape(len(counts), len(subjects))
        p = c + (0.02 * c.sum(axis=1, keepdims=True) + 0.1) * prior
        self.p = p / p.sum(axis=1, keepdims=True) if len(p) else p
        self.log = np.log(self.p / prior) if len(p) else p

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_names": None}

    @property
    def at(self) -> dict[str, int]:
        """Row by term, for inspection: a job over the texts that looks up the terms behind the hashes."""
        return {w: int(np.searchsorted(self.keys, h)) for h, w in self._names(self.keys)} if len(self.keys) and self._names else {}

    def known(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of known terms, their rows)."""
        if not len(self.keys) or not len(flat):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        row = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[row] == flat)
        return at, row[at]

    def judge(self, of: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For known terms (``rows``) of the units ``of`` (ascending): (units, their scores, where each unit starts)."""
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, dtype=np.int64)
        score = np.add.reduceat(self.log[rows], starts, axis=0) if len(of) else np.zeros((0, len(self.subjects)))
        return of[starts], score, starts

    def votes(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sure subject, or -1, of units of ``sizes`` terms each."""
        out = np.full(len(sizes), -1)
        at, rows = self.known(flat)
        unit, score, _ = self.judge(np.repeat(np.arange(len(sizes)), sizes)[at], rows)
        out[unit] = _sure(score)
        return out


def common_terms(read: DataFrame, n_subjects: int) -> DataFrame:
    """(w): the terms that are common in a language. The fewer documents a language has, the clearer that must be."""
    part = min(0.5, COMMON / n_subjects)
    n = read.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("docs"))  # codes of two or three letters
    terms = read.where("lang IS NOT NULL").select("lang", F.explode(F.array_distinct("ids")).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("df"))
    usual = F.lit(part) * F.col("docs") + F.lit(SPREAD) * F.sqrt(F.lit(part * (1 - part)) * F.col("docs"))
    return terms.join(F.broadcast(n), "lang").where(F.col("df") > usual).select("w").distinct()


def _select(counted: DataFrame, subjects: list[str], least: float, g_min: float) -> dict[int, np.ndarray]:
    """The terms whose subjects differ from the mix of all terms beyond chance; the ``LEXICON`` most telling ones."""
    s_of = {s: k for k, s in enumerate(subjects)}
    total = {r["s"]: r["n"] for r in counted.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # one row per subject
    everything = sum(total.values()) or 1.0
    prior = F.create_map(*(x for s in subjects for x in (F.lit(s), F.lit(max(total.get(s, 0.0), 0.5) / everything))))
    by = counted.groupBy("w").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("m"))
    parts = F.transform(F.map_entries("m"), lambda e: e["value"] * F.log(e["value"] / F.col("all") / F.element_at(prior, e["key"])))
    g = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    top = F.aggregate(F.slice(F.sort_array(F.map_values("m"), asc=False), 1, 3), F.lit(0.0), lambda a, x: a + x) / F.col("all")
    chosen = by.where(F.col("all") >= least).withColumn("g", g).where((F.col("g") >= g_min) & (top >= _TOP3))
    out = {}
    for r in chosen.orderBy(F.desc("g"), "w").limit(LEXICON).collect():
        v = np.zeros(len(subjects))
        for s, n in r["m"].items():
            v[s_of[s]] = n
        out[r["w"]] = v
    return out


def clean_labels(labels: DataFrame, areas: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, subject, weight): distinct labels of known subjects; a document's labels weigh one together."""
    tidy = lambda c: F.lower(F.trim(c))
    known = areas.select(tidy(F.col("subject")).alias("subject")).where("subject IS NOT NULL AND subject <> ''").distinct()
    rows = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tidy(F.col("subject")).alias("subject")).distinct().join(known, "subject", "left_semi")
    n = rows.groupBy("id").agg(F.count("*").alias("n"))
    return rows.join(n, "id").select("id", "subject", (1.0 / F.col("n")).alias("weight"))


def labelled_sample(read: DataFrame, labels: DataFrame) -> DataFrame:
    """(s, weight, ids, address, source): the labelled documents that the tables are learned from, at most ``LABELLED``."""
    sample = labels.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    taken = labels.join(sample, "id", "left_semi").join(read.select("id", "ids", "address", "source"), "id")
    return materialize(taken.select(F.col("subject").alias("s"), "weight", F.array_distinct("ids").alias("ids"), "address", "source"), "labelled")


def _weighed(labelled: DataFrame, col: str) -> DataFrame:
    return labelled.select(F.explode(col).alias("w"), "s", "weight").groupBy("w", "s").agg(F.sum("weight").alias("n"))


def learn_lexicon(read: DataFrame, labelled: DataFrame, subjects: list[str], names: Callable | None = None) -> Lexicon:
    """From the labelled documents, then ``ROUNDS`` counts over all documents."""
    common = materialize(common_terms(read, len(subjects)), "common")
    counts = _select(_weighed(labelled, "ids").join(common, "w", "left_anti"), subjects, SEED_DOCS, SEED_G)
    flat, k = np.full(len(subjects), 1.0 / len(subjects)), len(subjects)
    for _ in range(ROUNDS):
        lex = Lexicon(subjects, counts, flat)

        def count(batches: Iterator[pa.RecordBatch], lex: Lexicon = lex) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in _slices(b):
                    (terms, of_doc), (sizes, _) = _flat(part, "ids"), _flat(part, "sizes")
                    sent = np.repeat(np.arange(len(sizes)), sizes)
                    at, rows = lex.known(terms)
                    unit, score, starts = lex.judge(sent[at], rows)
                    if not len(unit):
                        continue
                    verdict = np.full(len(sizes), -1)
                    verdict[unit] = _sure(score)
                    z = verdict[sent]
                    n = np.diff(np.append(starts, len(at)))
                    own = np.repeat(np.arange(len(unit)), n)
                    z[at] = np.where(n[own] > 1, _sure(score[own] - lex.log[rows]), -1)  # a term has no say on itself
                    said = np.flatnonzero(z >= 0)
                    doc = np.repeat(np.arange(part.num_rows), of_doc)
                    once = pd.DataFrame({"w": terms[said], "dz": doc[said] * k + z[said]}).drop_duplicates()
                    tally = once.assign(z=once["dz"] % k).groupby(["w", "z"]).size()
                    w, zs = tally.index.get_level_values(0).to_numpy(), tally.index.get_level_values(1).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(zs, pa.int32()), pa.array(tally.to_numpy(), pa.float64())], names=["w", "z", "n"])

        name = F.element_at(F.array(*map(F.lit, subjects)), F.col("z") + 1)
        counted = read.select("ids", "sizes").mapInArrow(count, "w bigint, z int, n double").groupBy("w", "z").agg(F.sum("n").alias("n"))
        counted = counted.join(common, "w", "left_anti").select("w", name.alias("s"), "n")
        counts = _select(materialize(counted, "lexicon"), subjects, 3.0, _G_MIN)
    return Lexicon(subjects, counts, flat, names)


def learn_names(labelled: DataFrame, col: str, subjects: list[str], about: dict[str, str]) -> Lexicon:
    """The table of address or source words: those that tell a subject beyond chance among the labelled documents, and the
    words of the subjects' names and descriptions that only one subject has."""
    counts = _select(_weighed(labelled, col), subjects, 3.0, _G_MIN)
    own: dict[str, set[int]] = {}
    for k, s in enumerate(subjects):
        described = re.findall(r"[^\W\d_]{4,}", (about.get(s) or "").casefold())  # shorter words are those of every description
        for w in {*re.findall(r"[^\W\d_]+", s.casefold()), *described}:
            own.setdefault(w, set()).add(k)
    hashes = _Hashes()
    for w, of in own.items():
        if len(of) == 1 and hashes[w] not in counts:
            counts[hashes[w]] = np.eye(len(subjects))[min(of)]
    return Lexicon(subjects, counts, np.full(len(subjects), 1.0 / len(subjects)))


def _majority(counts: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Per row the subject of ``among`` that holds more than half of their counts, or -1."""
    c = np.where(among, counts, 0)
    best = c.argmax(axis=1)
    return np.where(np.take_along_axis(c, best[:, None], axis=1)[:, 0] * 2 > c.sum(axis=1), best, -1)


def expected(patterns: np.ndarray, counts: np.ndarray, acc: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentences per subject, right votes per function, votes per function) under the posterior of the patterns."""
    post = posterior(patterns, acc, prior)
    n_f = patterns.shape[1]
    right, votes = np.zeros(n_f), np.zeros(n_f)
    for f in range(n_f):
        on = patterns[:, f] >= 0
        right[f], votes[f] = (counts[on] * post[on, patterns[on, f]]).sum(), counts[on].sum()
    return counts @ post, right, votes


def updated(of_subject: np.ndarray, right: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = len(of_subject)
    return np.clip((right + 1) / (votes + 2), 1.0 / k, 0.999), (of_subject + 1) / (of_subject.sum() + k)


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, k: int, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(accuracy per function, prior per subject) of the latent model. ``patterns``: votes per function, -1 abstains."""
    acc, prior = np.full(patterns.shape[1], 0.7), np.full(k, 1.0 / k)
    for _ in range(steps):
        acc, prior = updated(*expected(patterns, counts, acc, prior))
    return acc, prior


def posterior(patterns: np.ndarray, acc: np.ndarray, prior: np.ndarray) -> np.ndarray:
    k = len(prior)
    out = np.tile(np.log(prior), (len(patterns), 1))
    for f in range(patterns.shape[1]):
        on = np.flatnonzero(patterns[:, f] >= 0)
        out[on] += np.log((1 - acc[f]) / max(1, k - 1) + 1e-12)
        out[on, patterns[on, f]] += np.log(acc[f]) - np.log((1 - acc[f]) / max(1, k - 1) + 1e-12)
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


FUNCTIONS = ("lexicon", "section", "address", "source")
#: More vote patterns than this are summed up in jobs, one per step, instead of on the driver.
PATTERNS = 200_000


class SubjectModel:
    """Lexicon and label model over one collection; ``votes`` is a written table with one row per document and pattern."""

    def __init__(self, documents: DataFrame, labels: DataFrame, areas: DataFrame, **columns: str):
        self.read = read_documents(documents, **columns)
        self.kind = dict(self.read.dtypes)["id"]
        tidy = areas.select(F.lower(F.trim("subject")).alias("s"), *([F.col("about").cast("string").alias("about")] if "about" in areas.columns else [F.lit(None).cast("string").alias("about")]))
        rows = tidy.where("s IS NOT NULL AND s <> ''").groupBy("s").agg(F.max("about").alias("about")).orderBy("s").collect()
        self.subjects = [r["s"] for r in rows]  # the parameter table of subjects
        text_col = columns.get("text_col", "text")

        def names(keys: np.ndarray) -> list[tuple[int, str]]:
            def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                hashes = _Hashes()
                for pdf in batches:
                    words = {w for t in pdf["t"] for _, ws in sentences_of(t) for w in ws}
                    h = np.array([hashes[w] for w in words], dtype=np.int64)
                    hit = np.isin(h, keys)
                    yield pd.DataFrame({"h": h[hit], "w": np.array(list(words), dtype=object)[hit]})

            texts = documents.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))
            return [(r["h"], r["w"]) for r in texts.mapInPandas(find, "h bigint, w string").distinct().collect()]  # the model's terms

        if self.subjects:
            labelled = labelled_sample(self.read, clean_labels(labels, areas))
            self.lexicon = learn_lexicon(self.read, labelled, self.subjects, names)
            about = {r["s"]: r["about"] for r in rows}
            self.names = {c: learn_names(labelled, c, self.subjects, about) for c in ("address", "source")}
        else:
            self.lexicon = Lexicon([], {}, np.zeros(0))
            self.names = {"address": self.lexicon, "source": self.lexicon}
        self.votes = materialize(self._votes(), "votes")
        self.patterns = materialize(self.votes.groupBy(*FUNCTIONS).agg(F.sum("n").alias("n")), "patterns")
        self.accuracy, self.prior = self._fit()

    def _votes(self) -> DataFrame:
        lex, names, k = self.lexicon, self.names, len(self.subjects)

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in _slices(b):
                    (terms, _), (sizes, of_doc), (pars, _) = _flat(part, "ids"), _flat(part, "sizes"), _flat(part, "pars")
                    at, rows = lex.known(terms)
                    unit, score, starts = lex.judge(np.repeat(np.arange(len(sizes)), sizes)[at], rows)
                    if not len(unit):
                        continue
                    own = _sure(score)
                    able = np.maximum.reduceat(lex.p[rows], starts, axis=0) > 0.05
                    doc = np.repeat(np.arange(part.num_rows), of_doc)[unit]
                    place = doc.astype(np.int64) * (int(pars.max(initial=0)) + 1) + pars[unit]
                    par = np.cumsum(np.append(0, place[1:] != place[:-1]))
                    said = np.eye(k, dtype=np.int64)[np.maximum(own, 0)] * (own >= 0)[:, None]

                    def others(of: np.ndarray, said: np.ndarray = said) -> np.ndarray:
                        total = np.zeros((int(of[-1]) + 1, k), dtype=np.int64)
                        np.add.at(total, of, said)
                        return total[of] - said

                    may = able | (own >= 0)[:, None]  # an undecided sentence is open to the subjects of its own terms only
                    section = _majority(others(par), may)
                    section = np.where(section >= 0, section, _majority(others(doc), may))
                    address, source = (names[c].votes(*_flat(part, c))[doc] for c in ("address", "source"))
                    packed = np.packbits(able, axis=1)
                    sets, which = np.unique(packed, axis=0, return_inverse=True)
                    rows = pd.DataFrame({"doc": doc, "lexicon": own, "section": section, "address": address, "source": source, "able": which.ravel()})
                    n = rows.groupby(list(rows.columns), sort=False).size().reset_index(name="n")
                    ids = part.column(part.schema.get_field_index("id")).take(pa.array(n["doc"].to_numpy()))
                    masks = [bytes(m) for m in sets]
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(n[f].to_numpy(), pa.int32()) for f in FUNCTIONS), pa.array([masks[i] for i in n["able"]], pa.binary()), pa.array(n["n"].to_numpy(), pa.int64())], names=["id", *FUNCTIONS, "able", "n"])

        return self.read.select("id", "address", "source", "ids", "sizes", "pars").mapInArrow(vote, f"id {self.kind}, " + ", ".join(f"{f} int" for f in FUNCTIONS) + ", able binary, n bigint")

    def _fit(self) -> tuple[np.ndarray, np.ndarray]:
        k = max(1, len(self.subjects))
        if self.patterns.limit(PATTERNS + 1).count() > PATTERNS:
            return self._fit_in_jobs(k)
        rows = self.patterns.orderBy(*FUNCTIONS).collect()  # at most PATTERNS rows
        if not rows:
            return np.full(len(FUNCTIONS), 0.7), np.full(k, 1.0 / k)
        return fit_accuracies(np.array([[r[f] for f in FUNCTIONS] for r in rows]), np.array([r["n"] for r in rows], dtype=float), k)

    def _fit_in_jobs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same steps, with the sums over the patterns made by the tasks."""
        acc, prior = np.full(len(FUNCTIONS), 0.7), np.full(k, 1.0 / k)
        for _ in range(50):

            def sums(batches: Iterator[pd.DataFrame], acc: np.ndarray = acc, prior: np.ndarray = prior) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    if len(pdf):
                        yield pd.DataFrame({"v": [np.concatenate(expected(pdf[list(FUNCTIONS)].to_numpy(), pdf["n"].to_numpy(dtype=float), acc, prior)).tolist()]})

            parts = self.patterns.mapInPandas(sums, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i")
            total = np.array([r["v"] for r in parts.collect()])  # subjects + 2 * functions numbers
            acc, prior = updated(total[:k], total[k : k + len(FUNCTIONS)], total[k + len(FUNCTIONS) :])
        return acc, prior

    def functions(self) -> DataFrame:
        """(function, coverage, accuracy): the part of the sentences on which a function votes, and its learned accuracy."""
        total = F.sum("n").cast("double")
        on = self.patterns.agg(*((F.sum(F.when(F.col(f) >= 0, F.col("n")).otherwise(0)) / total).alias(f) for f in FUNCTIONS)).first()
        return self.read.sparkSession.createDataFrame([(f, on[f] or 0.0, float(a)) for f, a in zip(FUNCTIONS, self.accuracy)], "function string, coverage double, accuracy double")

    def sentence_subjects(self) -> DataFrame:
        """(id, subject number, probability, n): the most probable subject of the sentences that have one."""
        acc, prior = self.accuracy, self.prior

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                post = posterior(pdf[list(FUNCTIONS)].to_numpy(), acc, prior)
                able = np.unpackbits(np.frombuffer(b"".join(pdf["able"]), dtype=np.uint8).reshape(len(pdf), -1), axis=1, count=len(prior))
                post *= able
                best = post.argmax(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "s": best.astype(np.int32), "p": post[np.arange(len(post)), best] / post.sum(axis=1), "n": pdf["n"]})

        return self.votes.mapInPandas(decide, f"id {self.kind}, s int, p double, n bigint")

    def document_subjects(self, share: float = SHARE) -> DataFrame:
        """(id, subject, sentences, share, probability) for every subject with its share of the sentences. One shuffle."""
        each = self.sentence_subjects()
        of = [(s, F.col("s") == k) for k, s in enumerate(self.subjects)]
        zero = F.lit(0).cast("bigint")
        sums = [F.struct(F.lit(s).alias("subject"), F.sum(F.when(on, F.col("n")).otherwise(zero)).alias("sentences"), F.sum(F.when(on, F.col("n") * F.col("p")).otherwise(F.lit(0.0))).alias("p")) for s, on in of]
        none = F.array().cast("array<struct<subject:string,sentences:bigint,p:double>>")
        n = each.groupBy("id").agg((F.array(*sums) if sums else none).alias("by"), F.sum("n").alias("total"))
        rows = n.select("id", "total", F.explode("by").alias("b")).select("id", "b.subject", "b.sentences", (F.col("b.sentences") / F.col("total")).alias("share"), (F.col("b.p") / F.col("b.sentences")).alias("probability"))
        return rows.where((F.col("sentences") > 0) & (F.col("share") >= share - 1e-12))


def composition(assigned: DataFrame) -> DataFrame:
    """(subject, documents, sentences): what the corpus is about."""
    return assigned.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))
