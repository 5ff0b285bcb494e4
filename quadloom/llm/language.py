"""Language of every document and of every foreign line, with confidence, by fusing evidence in Bayes' manner.

Text evidence: naive Bayes over hashed character n-grams and words, summed by line. A document's log-likelihood for a
language sums over its lines, each taken as a mixture: mostly the document's language, rarely any other, so a foreign
line costs little. Words of a text are no independent observations, so the sum is tempered by a power of its length,
which is fitted on held-out lines and parts of lines (Model). To this come the declared label, the country prefix of the publication number, and the languages of
the host (applicant), smoothed towards those of its source and those towards the whole corpus. The tables of label,
prefix, source and host against language are grouped aggregations over all documents.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE_DOCS) and then again on the lines of that sample as
it reads them itself, which removes wrong labels and foreign lines. All else covers every document and whole texts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.spans import Spelled, span_hashes
from quadloom.llm.tokenizer import _BLANK, _DIGIT, _LETTER, char_classes
from quadloom.operators.skew import look_up
from quadloom.session import cut_lineage, spread

LANGS = ("en", "de", "fr", "es", "it", "pt", "nl", "ru", "zh", "ja")
_K = len(LANGS)

#: Most labelled documents that the classifier is fitted on, chosen by a hash of their id.
SAMPLE_DOCS = 4000
#: Characters that a document of the sample may have; longer ones are not chosen.
SAMPLE_CHARS = 20_000
#: Hash buckets of the n-grams.
BUCKETS = 1 << 18
#: Lengths of the character n-grams inside a word and its two borders.
GRAMS = (1, 2, 3, 4)
#: Pseudo-count of every bucket, and the total that each language's counts are scaled to, so that grams never seen
#: favour no language.
ALPHA, TOTAL = 0.05, 200_000.0
#: Grams of a word overlap; their summed evidence is divided by this.
OVERLAP = 5.0
#: Evidence that a line of the sample is in the language of its label.
LABEL_WEIGHT = 6.0
#: Share of lines that are in another language than their document.
FOREIGN = 0.05
#: Letters that count as one observation of the document's language.
LETTERS_PER_OBSERVATION = 12.0
#: Shortest line in characters that can be a foreign segment, and least share of letters in what is not blank; below
#: it a line is a formula, a number or a mark.
SHORTEST_LINE, LETTER_SHARE = 20, 0.6
#: Longest word in letters, in scripts that put spaces between words.
LONGEST_WORD = 32
#: Words on either side whose evidence is added to a word's own when the words of a line are counted by language.
CONTEXT = 3
#: Evidence by which a line must favour another language than its document's.
LEAST_GAIN = 4.0
#: Letters of Chinese and Japanese that count as one word.
WIDE_LETTERS = 2.0
#: Weight of the wider level in the smoothed priors, in documents.
SMOOTHING = 20.0
#: Every so many documents of the sample one is held out to temper the evidence, with at most so many of its lines and
#: parts of lines of so many words.
HELD_OUT, HELD_LINES, PART_WORDS = 4, 2000, (1, 2, 3, 5, 8, 13)
#: The grid of the tempering: factor and power of the observations.
FACTORS, POWERS = tuple(2.0**k for k in np.arange(-4, 4.5, 0.5)), (0.0, 0.2, 0.4, 0.6, 0.8)
#: Words that a worker remembers; beyond that it starts anew.
REMEMBERED = 300_000
CHUNK = 1 << 20

#: Frequent words of each language, so that the classifier knows all languages even from few labelled rows (fixed values).
SEED_WORDS = {
    "en": "the of and to a in is that it for as with was on are by this be at from or an which not have but one can all when were there their has been if other than",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "fr": "le la les de des et est un une en que qui dans du pour pas sur au par plus avec ce il sont aux ou être cette comme se son mais elle ont peut leur sans été",
    "es": "el la los las de y en que es un una por con para del se no al lo como más pero sus le ha o este sí porque esta entre cuando muy sin sobre también hasta hay",
    "it": "il lo la i gli le di e che è un una in per con del della si non al sono da dei come più anche nel alla ma ha delle essere questo quando molto senza tra fra",
    "pt": "o a os as de e que é um uma em para com do da se não no na por mais dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela são",
    "nl": "de het een en van is in op te dat die voor met zijn niet aan er om ook als bij maar dan uit door naar over wordt worden wanneer deze kan meer geen heeft nog wel",
    "ru": "и в не на что с по это как а то все она так его но да ты к у же вы за бы только ее мне было вот от меня еще нет о из при для или если который также",
    "zh": "的 一 是 在 不 了 有 和 人 这 中 大 为 上 个 国 我 以 要 他 时 来 用 们 生 到 作 地 于 出 就 分 对 成 会 可 主 发 年 动 同 也 能 下 过 子 说 种 面 而 方 后 多",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず",
}
#: Names that labels use for each language, in lower case (fixed values). Region and script after - or _ are ignored.
LABELS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castilian",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands",
    "ru": "ru rus russian русский",
    "zh": "zh zho chi chinese cmn 中文 汉语",
    "ja": "ja jpn jp japanese 日本語",
}


def label_code(label: Column) -> Column:
    """The code that a label names, in any spelling; null for none of the ten."""
    first = F.lower(F.regexp_extract(F.trim(label), r"^([^-_.,;\s(]+)", 1))
    out = None
    for code, names in LABELS.items():
        due = first.isin(*names.split())
        out = F.when(due, code) if out is None else out.when(due, code)
    return out


@dataclass
class Page:
    """Lines of a list of texts, and words as spans over the code points of the cleaned texts."""

    cp: np.ndarray
    line_doc: np.ndarray  # of each line that is not blank
    line_no: np.ndarray  # from 1
    line_size: np.ndarray  # characters without outer blanks
    line_solid: np.ndarray  # characters that are not blank once cleaned
    word_start: np.ndarray
    word_end: np.ndarray
    word_line: np.ndarray


_MARKUP = re.compile(r"<[a-z/!?][^<>\n]{0,200}>|\\[a-z]+|\[math\s\d+\]")


def cleaned(text: str) -> str:
    """Lower case without tags, entities and formula commands; line feeds stay as they are."""
    if "&" in text:
        lines = text.count("\n")
        plain = html.unescape(html.unescape(text))
        text = plain if plain.count("\n") == lines else text
    text = text.lower()
    return _MARKUP.sub(" ", text) if "<" in text or "\\" in text or "[math" in text else text


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _solid(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that are not blank, and for every line the first and the last of them."""
    solid = np.flatnonzero(char_classes()[cp] != _BLANK)
    cuts = np.flatnonzero(cp == 10)
    return solid, np.searchsorted(solid, np.concatenate([[0], cuts + 1])), np.searchsorted(solid, np.append(cuts, len(cp)))


def read_page(texts: list[str]) -> Page:
    cp = _points("\n".join(texts))
    solid, lo, hi = _solid(cp)
    keep = hi > lo
    doc_lines = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    line_doc = np.repeat(np.arange(len(texts)), doc_lines)[keep]
    before = np.searchsorted(line_doc, line_doc)  # first line of the same text
    size = (solid[hi[keep] - 1] - solid[lo[keep]] + 1) if keep.any() else np.zeros(0, dtype=np.int64)
    # The same lines without markup, and their words.
    cp = _points("\n".join(map(cleaned, texts)))
    kind = char_classes()[cp]
    _, lo, hi = _solid(cp)
    letter = np.zeros(len(cp) + 2, dtype=np.int8)
    letter[1:-1] = kind == _LETTER
    step = np.diff(letter)
    ws, we = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # In scripts with spaces, single letters and letters beside digits are signs, and long runs are sequences.
    wide = np.concatenate([[0], np.cumsum(cp >= 0x2E80)])
    digit = np.zeros(len(cp) + 2, dtype=bool)
    digit[1:-1] = kind == _DIGIT
    plain = (we - ws >= 2) & (we - ws <= LONGEST_WORD) & ~digit[ws] & ~digit[we + 1]
    word = plain | (wide[we] - wide[ws] > 0)
    ws, we = ws[word], we[word]
    place = np.cumsum(keep) - 1
    line = place[np.searchsorted(np.flatnonzero(cp == 10), ws)] if len(ws) else np.zeros(0, dtype=np.int64)
    return Page(cp, line_doc, np.arange(len(line_doc)) - before + 1, size, (hi - lo)[keep], ws, we, line)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature, and the word it belongs to: n-grams over ^word$ and the word itself."""
    text = "".join(f"\x02{w}\x03" for w in words)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words)))
    starts = np.concatenate([[0], ends[:-1]])
    word = np.repeat(np.arange(len(words)), ends - starts)
    stop = np.repeat(ends, ends - starts)
    buckets, owners = [], []
    place = np.arange(len(cp))
    h = np.zeros(len(cp), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(cp) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + (cp[n - 1 :].astype(np.uint64) + np.uint64(n * 0x10001))
        if n in GRAMS:
            fits = np.flatnonzero(place[: len(h)] + n <= stop[: len(h)])
            if n == 1:
                fits = fits[cp[fits] > 3]
            x = h[fits] * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            buckets.append((x * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - 18))
            owners.append(word[fits])
    whole = span_hashes(cp, starts, ends) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - 18)
    return np.concatenate([*buckets, whole]).astype(np.int64), np.concatenate([*owners, np.arange(len(words))])


@dataclass
class Model:
    """The n-gram tables, BUCKETS x languages. Evidence of n observations is divided by factor * n ** power.

    `doubt` is the probability that a document is read wrongly however clear it seems: as many errors as the held-out
    documents cannot rule out.
    """

    table: np.ndarray
    factor: float = 1.0
    power: float = 0.0
    doubt: float = 0.01

    def tempered(self, evidence: np.ndarray, observations: np.ndarray) -> np.ndarray:
        return evidence / (self.factor * np.maximum(observations, 0.05) ** self.power)[:, None]

    def to_bytes(self) -> bytes:
        return np.array([self.factor, self.power, self.doubt], dtype=np.float64).tobytes() + self.table.astype(np.float32).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        return cls(np.frombuffer(data[24:], dtype=np.float32).reshape(BUCKETS, _K), *np.frombuffer(data[:24], dtype=np.float64).tolist())


class Reader:
    """Log-likelihoods of words and lines under the n-gram tables of the languages."""

    def __init__(self, model: Model) -> None:
        self.model, self.table = model, model.table
        self.spelled = Spelled(REMEMBERED)
        self._forget()

    def _forget(self) -> None:
        self.scores = np.zeros((0, _K), dtype=np.float32)

    def _score(self, words: list[str]) -> np.ndarray:
        bucket, word = grams(words)
        order = np.argsort(word, kind="stable")
        at = np.searchsorted(word[order], np.arange(len(words)))
        return np.add.reduceat(self.table[bucket[order]], at, axis=0) / OVERLAP

    def words(self, page: Page) -> np.ndarray:
        """Scores of every word of a page."""
        if not len(page.word_start):
            return np.zeros((0, _K), dtype=np.float32)
        number, new, forgotten = self.spelled.numbers(page.cp, page.word_start, page.word_end)
        if forgotten:
            self._forget()
        if len(new):
            words = [page.cp[page.word_start[k] : page.word_end[k]].tobytes().decode("utf-32-le", "replace") for k in new]
            self.scores = np.concatenate([self.scores, self._score(words)])
        return self.scores[number]

    def lines(self, page: Page, s: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Score of every line and language, and the letters of every line."""
        n = len(page.line_doc)
        scores, letters = np.zeros((n, _K)), np.zeros(n)
        if len(page.word_start):
            s = self.words(page) if s is None else s
            has, at = np.unique(page.word_line, return_index=True)
            scores[has] = np.add.reduceat(s, at, axis=0)
            letters[has] = np.add.reduceat(page.word_end - page.word_start, at)
        return scores, letters


def _table(counts: np.ndarray) -> np.ndarray:
    scaled = counts * (TOTAL / np.maximum(counts.sum(axis=0), 1.0))
    logs = np.log((scaled + ALPHA) / (TOTAL + ALPHA * BUCKETS))
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def _fit_table(page: Page | None, codes: list[str]) -> np.ndarray:
    """The n-gram table from labelled texts: once by their labels, then twice by the lines as read so far."""
    place = {c: i for i, c in enumerate(LANGS)}
    seed = np.zeros((BUCKETS, _K))
    for code, words in SEED_WORDS.items():
        bucket, _ = grams(words.split())
        seed[:, place[code]] += 3.0 * np.bincount(bucket, minlength=BUCKETS)
    if page is None or not len(page.word_start):
        return _table(seed)
    word, first, _ = Spelled(len(page.word_start)).numbers(page.cp, page.word_start, page.word_end)
    spelled = [page.cp[page.word_start[k] : page.word_end[k]].tobytes().decode("utf-32-le", "replace") for k in first]
    bucket, owner = grams(spelled)
    labelled = np.array([place[c] for c in codes])[page.line_doc]
    line_lang, counts = labelled, seed
    for _ in range(3):
        lang = line_lang[page.word_line]
        times = np.bincount(word * (_K + 1) + np.where(lang < 0, _K, lang), minlength=len(first) * (_K + 1)).reshape(-1, _K + 1)[:, :_K]
        counts = seed.copy()
        for k in range(_K):
            counts[:, k] += np.bincount(bucket, weights=times[owner, k].astype(float), minlength=BUCKETS)
        scores, letters = Reader(Model(_table(counts))).lines(page)
        scores[np.arange(len(scores)), labelled] += LABEL_WEIGHT
        line_lang = np.where(letters > 0, scores.argmax(axis=1), -1)
    return _table(counts)


def fit(texts: list[str], codes: list[str]) -> Model:
    """The model from labelled texts. Every HELD_OUT-th text tempers the evidence and takes no part in the table."""
    held = np.arange(len(texts)) % HELD_OUT == HELD_OUT - 1
    pick = lambda x, due: [v for v, d in zip(x, due, strict=True) if d]
    page = read_page(pick(texts, ~held)) if (~held).any() else None
    model = Model(_fit_table(page, pick(codes, ~held)))
    return temper(model, pick(texts, held), pick(codes, held)) if held.any() else model


def temper(model: Model, texts: list[str], codes: list[str]) -> Model:
    """`model` with factor and power of least surprise on lines of texts it was not fitted on, and on their first words.

    What a text is in is read from all of it and its label. A line is in another language with probability FOREIGN, as
    everywhere, so foreign lines do not pass for errors.
    """
    page = read_page(texts)
    reader = Reader(model)
    words = reader.words(page)
    scores, letters = reader.lines(page, words)
    evidence = np.zeros((len(texts), _K))
    np.add.at(evidence, page.line_doc, _line_evidence(scores) * _observations(page, letters)[:, None])
    evidence[np.arange(len(texts)), [LANGS.index(c) for c in codes]] += LABEL_WEIGHT
    lines = np.flatnonzero(_wordy(page, letters) & (letters > 0))
    # Lines in an order that does not go by text.
    lines = lines[np.argsort((lines * 2_654_435_761) % 4_294_967_296)][:HELD_LINES]
    if not len(lines):
        return model
    truth = evidence.argmax(axis=1)[page.line_doc[lines]]
    sums = np.concatenate([np.zeros((1, _K)), np.cumsum(words, axis=0, dtype=float)])
    sizes = np.concatenate([[0], np.cumsum(page.word_end - page.word_start)])
    first, last = (np.searchsorted(page.word_line, lines, side=x) for x in ("left", "right"))
    parts, seen, right = [], [], []
    for n in (*PART_WORDS, len(words)):
        end = np.minimum(first + n, last)
        seen.append((sizes[end] - sizes[first]) / LETTERS_PER_OBSERVATION)
        parts.append(_line_evidence(sums[end] - sums[first]) * seen[-1][:, None])
        right.append(truth)
    part, n, right = np.concatenate(parts), np.concatenate(seen), np.concatenate(right)
    best = (np.inf, 1.0, 0.0)
    for power in POWERS:
        for factor in FACTORS:
            p = np.exp(_log_softmax(Model(model.table, factor, power).tempered(part, n)))[np.arange(len(part)), right]
            best = min(best, (-np.log((1 - FOREIGN) * p + FOREIGN / _K).sum(), factor, power))
    return Model(model.table, best[1], best[2], 1.0 / (len(texts) + 2))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _line_evidence(scores: np.ndarray) -> np.ndarray:
    """Log-likelihood of each line for a document of each language, as one observation: rarely the line is foreign."""
    return np.log((1 - FOREIGN) * np.exp(_log_softmax(scores)) + FOREIGN / _K)


def _wordy(page: Page, letters: np.ndarray) -> np.ndarray:
    """Lines that are mostly letters; a letter of Chinese or Japanese stands for more of a text than one of the others."""
    wide = np.zeros(len(page.line_doc))
    if len(page.word_start):
        sums = np.concatenate([[0], np.cumsum(page.cp >= 0x2E80)])
        np.add.at(wide, page.word_line, sums[page.word_end] - sums[page.word_start])
    more = (WIDE_LETTERS - 1.0) * wide
    return letters + more >= LETTER_SHARE * (page.line_solid + more)


def _observations(page: Page, letters: np.ndarray) -> np.ndarray:
    return np.where(_wordy(page, letters), letters, 0.25 * letters) / LETTERS_PER_OBSERVATION


def _share(page: Page, s: np.ndarray, ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Share of the words of each line that read as `theirs[line]` rather than as `ours[line]`.

    Each word is judged with CONTEXT words on either side of it in its line, as short words fit many languages.
    """
    share = np.zeros(len(page.line_doc))
    if not len(s):
        return share
    line, place = page.word_line, np.arange(len(s))
    gain = np.clip(s[place, theirs[line]] - s[place, ours[line]], -3.0, 3.0)
    sums = np.concatenate([[0.0], np.cumsum(gain, dtype=float)])
    first, last = np.searchsorted(line, line), np.searchsorted(line, line, side="right")
    near = sums[np.minimum(place + CONTEXT + 1, last)] - sums[np.maximum(place - CONTEXT, first)]
    wide = page.cp[page.word_start] >= 0x2E80
    weight = np.where(wide, (page.word_end - page.word_start) / WIDE_LETTERS, 1.0)
    has, at = np.unique(line, return_index=True)
    share[has] = np.add.reduceat(weight * (near > 0), at) / np.add.reduceat(weight, at)
    return share


def read_texts(reader: Reader, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
    """Tempered text evidence of each document (log-likelihood by language), and its lines that can be segments.

    Lines are listed where they differ from the best language of the text alone, and all of them where that is in
    doubt, as the other evidence may then decide otherwise. `odds` is the tempered log-likelihood of a line's language
    against that of its text, or of the next best where both are the same.
    """
    page = read_page(texts)
    words = reader.words(page)
    scores, letters = reader.lines(page, words)
    wordy, observed = _wordy(page, letters), _observations(page, letters)
    by_line = _line_evidence(scores)
    evidence, total = np.zeros((len(texts), _K)), np.zeros(len(texts))
    np.add.at(evidence, page.line_doc, by_line * observed[:, None])
    np.add.at(total, page.line_doc, observed)
    evidence = reader.model.tempered(evidence - evidence.max(axis=1, keepdims=True), total)
    best = evidence.argmax(axis=1)
    sure = (np.sort(evidence, axis=1)[:, -2] < -20.0)[page.line_doc]
    # A line's words are counted for the document's language and the best other one.
    ours = best[page.line_doc]
    others = scores.copy()
    others[np.arange(len(ours)), ours] = -np.inf
    theirs = others.argmax(axis=1)
    here = np.arange(len(ours))
    gain = scores[here, theirs] - scores[here, ours]
    foreign = (_share(page, words, ours, theirs) > 0.5) & (gain > LEAST_GAIN)
    lang = np.where(foreign, theirs, ours)
    heat = reader.model.tempered(by_line * observed[:, None], observed)
    odds = np.where(foreign, 1.0, -1.0) * (heat[here, theirs] - heat[here, ours])
    can = (page.line_size >= SHORTEST_LINE) & wordy & (letters > 0)
    listed = np.flatnonzero(can & ((lang != ours) | ~sure))
    segments: list[list[dict]] = [[] for _ in texts]
    for i in listed:
        segments[page.line_doc[i]].append({"para_no": int(page.line_no[i]), "lang": LANGS[lang[i]], "odds": float(odds[i])})
    return evidence, segments


_OPEN: dict[int, Reader] = {}


def fitted_model(documents: DataFrame) -> Model:
    """Fit on at most SAMPLE_DOCS labelled documents, those of least hash of their id.

    The sample is read and fitted in one task on an executor; only the model comes back.
    """
    code = label_code(F.col("lang")).alias("code")
    # The length comes from its own column where there is one, so that choosing reads no texts.
    size = F.col("n_chars") if "n_chars" in documents.columns else F.length("text")
    able = documents.select("doc_id", code, size.alias("size")).where(F.col("code").isNotNull() & F.col("size").between(1, SAMPLE_CHARS))
    # Only ids are sorted and sent, at most SAMPLE_DOCS by a task; the texts follow by a join with the chosen ids.
    chosen = able.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = documents.select("doc_id", "text", code).join(F.broadcast(chosen), "doc_id", "left_semi")
    rows = rows.where(F.col("code").isNotNull() & F.length("text").between(1, SAMPLE_CHARS)).select("text", "code").limit(SAMPLE_DOCS).coalesce(1)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        codes: list[str] = []
        for b in batches:
            texts += b.column(0).to_pylist()
            codes += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, codes).to_bytes()], pa.binary())], names=["model"])

    found = rows.mapInArrow(fitted, "model binary").collect()
    return Model.from_bytes(bytes(found[0].model)) if found else fit([], [])


def text_evidence(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, label, host, prefix, source, evidence ARRAY<FLOAT>, segments) of every document whose text is not blank."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = Reader(shared.value)
        reader = _OPEN[key]
        kind = pa.list_(pa.struct([("para_no", pa.int32()), ("lang", pa.string()), ("odds", pa.float32())]))
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
                    size += len(texts[hi])
                    hi += 1
                evidence, segments = read_texts(reader, texts[lo:hi])
                offsets = pa.array(np.arange(0, (hi - lo) * _K + 1, _K, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(evidence.astype(np.float32).ravel()))
                keep = [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*keep, lists, pa.array(segments, kind)], names=[*b.schema.names[:-1], "evidence", "segments"])
                lo = hi

    rows = documents.select(
        "doc_id",
        label_code(F.col("lang")).alias("label"),
        F.col("applicant").alias("host"),
        F.upper(F.substring(F.trim("pub_no"), 1, 2)).alias("prefix"),
        "source",
        "text",
    ).where(F.col("text").rlike(r"[^\s 　]"))
    key = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, label string, host string, prefix string, source string, evidence array<float>, segments array<struct<para_no:int,lang:string,odds:float>>"
    return spread(rows).mapInArrow(read, schema)


def _by_language(rows: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out ARRAY<DOUBLE>): documents of each language by text alone, per value of `key`."""
    n = [F.sum(F.when(F.col("best") == i, 1.0).otherwise(0.0)) for i in range(_K)]
    return rows.groupBy(key).agg(F.array(*n).alias(out))


def _smoothed(counts: Column, wider: Column) -> Column:
    """Shares of `counts` with SMOOTHING documents of `wider` mixed in; `wider` alone where counts is null."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(counts.isNull(), wider).otherwise(F.zip_with(counts, wider, lambda c, w: (c + SMOOTHING * w) / (total + SMOOTHING)))


def _likelihood(counts: Column, totals: Column) -> Column:
    """P(value | language) from the documents of a value and of all, by language."""
    share = F.zip_with(counts, totals, lambda c, t: (c + 0.5) / (t + 5.0))
    return F.when(counts.isNull(), F.array_repeat(F.lit(0.1).cast("double"), _K)).otherwise(share)


def _log(values: Column) -> Column:
    return F.transform(values, lambda x: F.ln(F.greatest(x, F.lit(1e-6))))


def document_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, label, lang, confidence DOUBLE, segments): the fused language of every document whose text is not blank.

    `label` is the code the delivered label names or null. `text_lang` is the language by the text alone, which the
    other evidence may outweigh where the text is short. `segments` are (para_no, lang, confidence) of the lines that
    can be foreign segments, of any language; their confidence weighs the line against the share of foreign lines and
    the languages of the host. A text without any letters is read from the other evidence alone. Null, empty and blank
    texts have no row; repeated rows have a row each.
    """
    model = fitted_model(documents)
    rows = text_evidence(documents, model)
    rows = cut_lineage(rows.withColumn("best", F.array_position("evidence", F.array_max("evidence")).cast("int") - 1))
    every = rows.agg(F.array(*[F.sum(F.when(F.col("best") == i, 1.0).otherwise(0.0)) for i in range(_K)]).alias("all"))
    out = rows.crossJoin(F.broadcast(every))  # one row
    for key in ("label", "prefix", "source", "host"):
        out = look_up(out, _by_language(rows.where(F.col(key).isNotNull()), key, f"by_{key}"), key)
    flat = F.array_repeat(F.lit(1.0 / _K).cast("double"), _K)
    out = out.withColumn("p_all", _smoothed(F.col("all"), flat))
    out = out.withColumn("p_source", _smoothed(F.col("by_source"), F.col("p_all")))
    out = out.withColumn("p_host", _smoothed(F.col("by_host"), F.col("p_source")))
    plus = lambda a, b: a + b
    total = F.zip_with(F.transform("evidence", lambda x: x.cast("double")), _log(F.col("p_host")), plus)
    total = F.zip_with(total, _log(_likelihood(F.col("by_label"), F.col("all"))), plus)
    total = F.zip_with(total, _log(_likelihood(F.col("by_prefix"), F.col("all"))), plus)
    out = out.withColumn("total", total).withColumn("top", F.array_max("total"))
    mass = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(c) for c in LANGS])
    at = F.array_position("total", F.col("top")).cast("int")
    certain = lambda p: F.lit(1 - model.doubt) * p + model.doubt / _K
    out = out.withColumn("lang", F.element_at(names, at))

    def segment(x: Column) -> Column:
        """A line in the text's own language has the odds of not being foreign, another one its share of the foreign lines."""
        mine = x["lang"] == F.col("lang")
        share = F.element_at("p_host", F.array_position(names, x["lang"]).cast("int"))
        prior = F.when(mine, F.log(F.lit((1 - FOREIGN) / FOREIGN))).otherwise(F.log(FOREIGN / (1 - FOREIGN) * (0.5 * share + 0.5 / _K)))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(x["odds"].cast("double") + prior)))
        return F.struct(x["para_no"].alias("para_no"), x["lang"].alias("lang"), certain(p).cast("float").alias("confidence"))

    return out.select(
        "doc_id", "label", F.element_at(names, F.col("best") + 1).alias("text_lang"), "lang", certain(F.lit(1.0) / mass).alias("confidence"), F.transform("segments", segment).alias("segments")
    )


def language_cases(documents: DataFrame) -> DataFrame:
    """(doc_id, para_no INT, lang, confidence): wrong or missing labels as para_no 0, foreign lines by their number.

    para_no 0: the label names none of the ten languages or another than the document's; para_no >= 1: a line of at
    least SHORTEST_LINE characters, mostly words, in another language than the document.
    """
    docs = document_languages(documents)
    whole = F.when(
        F.col("label").isNull() | (F.col("label") != F.col("lang")),
        F.array(F.struct(F.lit(0).alias("para_no"), F.col("lang"), F.col("confidence").cast("float").alias("confidence"))),
    ).otherwise(F.array().cast("array<struct<para_no:int,lang:string,confidence:float>>"))
    foreign = F.filter("segments", lambda x: x["lang"] != F.col("lang"))
    return docs.select("doc_id", F.explode(F.concat(whole, foreign)).alias("c")).select("doc_id", "c.para_no", "c.lang", "c.confidence")
