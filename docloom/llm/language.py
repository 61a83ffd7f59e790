"""Problem 6: languages of documents and of their segments by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is bound from its letters' vectors,
each permuted by its place; a text is the bundle (sum) of its trigrams' vectors, and so is
the prototype of a language. Texts and prototypes are compared by cosine. As the inner
product is linear, <text, prototype> is the sum of <trigram, prototype> over the text's
trigrams: those products are made once per trigram, and a text of any length costs one
lookup a character instead of DIM operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.charbatch import TOP, batches, code_points
from docloom.llm.residue import ERROR_PHRASES, FILLER_PHRASES, SCRIPT_DEMANDS, SCRIPT_WORDS

DIM = 2048
TRAIN_ROWS = 3000
LEAST_WORDS = 12
LEAST_LETTERS = 60
LEAST_COSINE = 0.10
SHORT_LETTERS = 60
HOME_BONUS = 0.15
TEMPERATURE = 0.02

# Names of the languages, and their commonest words.
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english", "englisch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
}
COMMON_WORDS = {
    "de": "der die das und in zu den mit von für ist im nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn können ich wir ihr auf dem des sich unter ohne gegen",
    "en": "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more two like him see time could no make than first been its who now my made over did down only way find use may",
    "fr": "le la les de des du un une et à en est que qui dans pour pas sur avec au ce il elle ne se son sa ses par plus je nous vous ils aux mais ou où leur être fait cette comme tout bien sans sous après avant été entre même aussi très peu quand chez dont deux ont était faire",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto antes algunos qué unos yo otro tras según",
    "it": "di e il la che in a per un è del non con una da sono le si dei al i alla della lo come nel più anche ma ha se gli delle su o questo era ci tra quando mi suo loro essere sua dal molto nella stato io ho fatto prima tutto due dopo fra senza perché degli agli dalla sulla presso",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit naar heeft ze hij werd door wordt over had kan meer geen deze zo tot al moet hebben worden wel je was die ik mijn onder tegen na zonder omdat veel toen wij jullie zou haar hun waar",
}
# A few sentences of everyday prose, so that small tables without usable labels have a start too.
PROSE = {
    "de": "Gestern haben wir den Brief erhalten und sofort an die zuständige Stelle weitergeleitet. Bitte schicken Sie uns die fehlenden Seiten bis zum Ende der Woche zurück. Wenn es noch Fragen gibt, können Sie uns jederzeit anrufen oder schreiben. Der Schlüssel liegt bei den Nachbarn im ersten Stock, weil niemand zu Hause war. Die Kinder gehen morgens zur Schule und kommen am Nachmittag wieder.",
    "en": "Yesterday we received the letter and passed it on to the right office at once. Please send us the missing pages back before the end of the week. If there are any more questions, you can call or write to us whenever you like. The key is with the neighbours on the first floor because nobody was at home. The children walk to school every morning and come back in the afternoon.",
    "fr": "Hier nous avons reçu la lettre et l'avons aussitôt transmise au service compétent. Veuillez nous renvoyer les pages manquantes avant la fin de la semaine. S'il reste des questions, vous pouvez nous appeler ou nous écrire quand vous voulez. La clé se trouve chez les voisins du premier étage parce que personne n'était à la maison. Les enfants vont à l'école le matin et reviennent l'après-midi.",
    "es": "Ayer recibimos la carta y la enviamos enseguida a la oficina correspondiente. Les rogamos que nos devuelvan las páginas que faltan antes del fin de semana. Si quedan preguntas, pueden llamarnos o escribirnos cuando quieran. La llave está en casa de los vecinos del primer piso porque no había nadie. Los niños van al colegio por la mañana y vuelven por la tarde.",
    "it": "Ieri abbiamo ricevuto la lettera e l'abbiamo subito inoltrata all'ufficio competente. Vi preghiamo di rimandarci le pagine mancanti entro la fine della settimana. Se ci sono ancora domande, potete chiamarci o scriverci quando volete. La chiave si trova dai vicini del primo piano perché in casa non c'era nessuno. I bambini vanno a scuola la mattina e tornano nel pomeriggio.",
    "nl": "Gisteren hebben we de brief ontvangen en meteen doorgestuurd naar de juiste afdeling. Stuur ons de ontbrekende bladzijden alstublieft voor het einde van de week terug. Als er nog vragen zijn, kunt u ons altijd bellen of schrijven. De sleutel ligt bij de buren op de eerste verdieping omdat er niemand thuis was. De kinderen gaan 's ochtends naar school en komen 's middags weer naar huis.",
}
LANGUAGES = tuple(NAMES)
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßáàâéèêëíìîïóòôúùûñçœæ"
SYMBOLS = len(LETTERS) + 1  # and 0 for anything else


def label_language(label: str | None) -> str | None:
    """The language that a label names, whatever its spelling (code, region, case, name), or None."""
    if not label:
        return None
    bare = re.split(r"[-_ ]", label.strip().lower(), maxsplit=1)[0]
    return next((code for code, names in NAMES.items() if bare in names), None)


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    table = np.zeros(TOP, np.uint8)
    for i, c in enumerate(LETTERS, 1):
        for form in {c, c.upper()}:
            if len(form) == 1:
                table[ord(form)] = i
    return table


@lru_cache(maxsize=1)
def _letter_vectors(dim: int) -> np.ndarray:
    return np.random.default_rng(20240701).choice(np.array([-1, 1], np.float32), (SYMBOLS, dim))


def _trigram_block(first: int, dim: int) -> np.ndarray:
    """Vectors of all trigrams that begin with one symbol: permuted letter vectors, bound by multiplication."""
    v = _letter_vectors(dim)
    second, third = np.roll(v, 1, axis=1), v
    return (np.roll(v[first], 2) * second[:, None, :] * third[None, :, :]).reshape(-1, dim)


def _grams(codes: np.ndarray) -> np.ndarray:
    s = _symbol_table()[codes].astype(np.int32)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


class Profiles:
    """Prototypes as <trigram, prototype> / |prototype| / sqrt(DIM) for every trigram and language."""

    def __init__(self, counts: np.ndarray, dim: int = DIM):
        counts = counts.astype(np.float32).copy()
        counts[0] = 0  # three symbols that are no letters
        counts = np.sqrt(counts / np.maximum(counts.sum(axis=0), 1))  # equal weight for each language, and no trigram fills a bundle
        square = SYMBOLS * SYMBOLS
        prototypes = sum(counts[a * square : (a + 1) * square].T @ _trigram_block(a, dim) for a in range(SYMBOLS))
        prototypes = prototypes - prototypes.mean(axis=0)  # what all languages share tells nothing
        prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True) + 1e-9
        self.scores = np.concatenate([_trigram_block(a, dim) @ prototypes.T for a in range(SYMBOLS)]).astype(np.float32) / np.sqrt(dim)
        self.scores[0] = 0

    def cosines(self, texts: list[str]) -> np.ndarray:
        """(texts, languages). The norm of a text's bundle is that of its trigrams being different ones."""
        if not texts:
            return np.zeros((0, len(LANGUAGES)), np.float32)
        codes = code_points("  " + "\n\n".join(texts) + "\n\n")
        lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
        start = np.zeros(len(texts), np.int64)
        np.cumsum(lengths[:-1], out=start[1:])
        sums = np.add.reduceat(self.scores[_grams(codes)], start, axis=0)
        return sums / np.sqrt(lengths)[:, None]


def gram_counts(texts: list[str]) -> np.ndarray:
    return np.bincount(_grams(code_points("  " + "\n\n".join(texts) + "\n\n")), minlength=SYMBOLS**3)


def _seed_counts() -> np.ndarray:
    return np.stack([gram_counts([COMMON_WORDS[code], PROSE[code]]) for code in LANGUAGES], axis=1)


@lru_cache(maxsize=1)
def _seed_profiles() -> Profiles:
    """The start of every fit: fixed, so made once a process."""
    return Profiles(_seed_counts())


def train(labelled: list[tuple[str, str]], rounds: int = 2) -> Profiles:
    """Prototypes of labelled texts. Labels may be wrong and texts mixed: each round the sentences move to the language they are nearest to."""
    sentences = [(code, s) for label, body in labelled if (code := label_language(label)) for _, s in sentences_of(body)]
    texts = [s for _, s in sentences]
    which = np.array([LANGUAGES.index(code) for code, _ in sentences], np.int64)
    seeds = _seed_counts()

    def bundle(named: np.ndarray) -> Profiles:
        return Profiles(seeds + np.stack([gram_counts([texts[i] for i in np.flatnonzero(named == k)]) for k in range(len(LANGUAGES))], axis=1))

    profiles = _seed_profiles()
    if texts:  # a label holds unless the start already tells another language
        cosines = profiles.cosines(texts)
        best, two = cosines.argmax(axis=1), np.sort(cosines, axis=1)
        profiles = bundle(np.where(two[:, -1] - two[:, -2] > 2 * TEMPERATURE, best, which))
    for _ in range(rounds if texts else 0):
        profiles = bundle(profiles.cosines(texts).argmax(axis=1))
    return profiles


_SKIPPED_LINE = re.compile(r"\s*(?:#|_Source:|\*\*[^*]*\*\*\s*$|---|[-*] *\[[^\]]*\]\(|(?:[-*] *)?[^\W\d_][\w .°'’/()-]{0,40}:(?: |$))")
_BULLET = re.compile(r"\s*[-*] +(?:\d{1,4}[-./ ]\S+(?: \S*\d{4})?)?")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_a-z]|[¿¡«\"'\d])")
_QUOTE = re.compile(r"«[^»\n]{0,80}»|\"[^\"\n]{0,80}\"|„[^“”\n]{0,80}[“”]|“[^”\n]{0,80}”")
_WORD = re.compile(r"[^\W\d_]+")
_ADDRESS = re.compile(r"\S+ ?(?:@|[\[(]at[\])]| AT ) ?\S+(?: DOT \S+)?|https?://\S+|www\.\S+")
_BAD = re.compile(
    r"(?<!\w)(?:" + "|".join(ERROR_PHRASES) + "|" + "|".join(FILLER_PHRASES) + rf")|(?<!\w)(?:{SCRIPT_WORDS})(?!\w).*(?:" + "|".join(SCRIPT_DEMANDS) + ")|(?:" + "|".join(SCRIPT_DEMANDS) + rf").*(?<!\w)(?:{SCRIPT_WORDS})(?!\w)"
)
_FILLER = re.compile("|".join(FILLER_PHRASES))


def _prose(sentence: str) -> str:
    """The sentence without short quotations and addresses."""
    if "@" in sentence or "at]" in sentence or "at)" in sentence or " AT " in sentence or "/" in sentence:
        sentence = _ADDRESS.sub(" ", sentence)
    return _QUOTE.sub(" ", sentence)


def sentences_of(body: str) -> Iterator[tuple[int, str]]:
    """(0-based start, text) of the sentences that may show a language: no headings, source markers, labelled lines, link lists, front matter, filler or quotations."""
    at = 0
    front = body.startswith("---\n")
    for line in body.split("\n"):
        here, at = at, at + len(line) + 1
        if front:
            front = not (here and line.startswith("---"))
            continue
        if len(line) < 4 or _SKIPPED_LINE.match(line) or _FILLER.search(line.lower()):
            continue
        start = m.end() if (m := _BULLET.match(line)) else 0
        last = start
        for m in _SENTENCE_END.finditer(line, start):
            # an ordinal, an initial or a short title doesn't end a sentence
            if m.start() - last >= 12:
                yield here + last, _prose(line[last : m.start()])
                last = m.end()
        if last < len(line):
            yield here + last, _prose(line[last:])


def _is_message(text: str) -> bool:
    return _BAD.search(re.sub(r"\d+(?:[.,:/\-]\d+)*", "0", text.lower())) is not None


def segments(bodies: list[str | None], profiles: Profiles) -> Iterator[list[tuple[int, str, float, int, int]]]:
    """For each body its segments (start_at from 1, language, confidence, words, letters): neighbouring sentences of one language together.

    A sentence too far from every prototype has no language; one of fewer than four words
    goes with the one before. Short sentences lean to the languages of the body's long ones.
    """
    parts = [list(sentences_of(b)) if b else [] for b in bodies]
    texts = [t for p in parts for _, t in p]
    cosines = np.concatenate([profiles.cosines(texts[a:b]) for a, b in batches(texts)]) if texts else np.zeros((0, len(LANGUAGES)))
    if len(texts):
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        long = np.fromiter((len(t) for t in texts), np.int64, len(texts)) >= SHORT_LETTERS
        home = np.zeros((len(parts), len(LANGUAGES)), bool)
        home[of[long], cosines[long].argmax(axis=1)] = True
        cosines = np.where(long[:, None], cosines, cosines + HOME_BONUS * home[of])
    scaled = np.exp((cosines - cosines.max(axis=1, keepdims=True)) / TEMPERATURE) if len(texts) else cosines
    best = cosines.argmax(axis=1) if len(texts) else np.zeros(0, int)
    i = 0
    for p in parts:
        rows: list[list] = []
        for at, text in p:
            words = _WORD.findall(text)
            k, i = best[i], i + 1
            cosine, sure = float(cosines[i - 1, k]), float(scaled[i - 1, k] / scaled[i - 1].sum())
            letters = sum(map(len, words))
            if letters > 20 * len(words):
                continue  # a run of letters without words
            if len(words) < 4:
                if rows and words:
                    rows[-1][3] += len(words)
                    rows[-1][4] += letters
                continue
            if cosine < LEAST_COSINE:
                continue
            code = LANGUAGES[k]
            if rows and rows[-1][1] == code:
                r = rows[-1]
                r[2] = (r[2] * r[3] + sure * len(words)) / (r[3] + len(words))
                r[3] += len(words)
                r[4] += letters
                r[5].append(text)
            else:
                rows.append([at + 1, code, sure, len(words), letters, [text]])
        # Messages of machines don't count, however often they are repeated.
        out = []
        for r in rows:
            kept = [t for t in r[5] if not _is_message(t)]
            if len(kept) < len(r[5]):
                found = [w for t in kept for w in _WORD.findall(t)]
                r[3], r[4] = len(found), sum(map(len, found))
            if r[3]:
                out.append(tuple(r[:5]))
        yield out


def _train_on(df: DataFrame, label: str, text: str, train_rows: int) -> Profiles:
    usable = df.where(F.col(label).isNotNull() & F.length(text).between(200, 4000)).select(label, text)
    # Those with the smallest hashes: rows from all over the table, the same in whatever order it is read.
    return train([(r[0], r[1]) for r in usable.orderBy(F.xxhash64(text), text, label).limit(train_rows).collect()])


def segment_languages(df: DataFrame, key: str, label: str, text: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """key, label, segment_no, start_at, lang, confidence, n_words, n_letters for each segment of each text.

    Prototypes are fitted on at most train_rows labelled rows, drawn by a hash of the text; every text is classified,
    whole. Null and empty texts have no segments; repeated rows repeat theirs.
    """
    profiles = _train_on(df, label, text, train_rows)
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # SYMBOLS^3 x languages, whatever the data
    kind = df.schema[key].dataType.simpleString()
    names = ["k", "label", "segment_no", "start_at", "lang", "confidence", "n_words", "n_letters"]

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bodies = part.column(2).to_pylist()
            for a, b in batches([t or "" for t in bodies]):
                found = list(segments(bodies[a:b], shared.value))
                take = pa.array([a + i for i, rows in enumerate(found) for _ in rows], pa.int64())
                flat = [(n, *row) for rows in found for n, row in enumerate(rows, 1)]
                cols = list(zip(*flat, strict=True)) if flat else [()] * 6
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(text).alias("t"))
    out = rows.mapInArrow(go, f"k {kind}, label string, segment_no int, start_at int, lang string, confidence double, n_words int, n_letters int")
    return out.withColumnRenamed("k", key)


def text_languages(segs: DataFrame, key: str, least_words: int = LEAST_WORDS, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """key, label, lang, n_words, confidence: each language of a text with at least that many words and letters in it; confidence is the mean over its words."""
    return (
        segs.groupBy(key, "label", "lang")
        .agg(F.sum("n_words").alias("n_words"), F.sum("n_letters").alias("n_letters"), (F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")).alias("confidence"))
        .where((F.col("n_words") >= least_words) & (F.col("n_letters") >= least_letters))
        .select(key, "label", "lang", "n_words", "confidence")
    )


def mislabelled(languages: DataFrame, key: str) -> DataFrame:
    """key, lang of texts whose label is missing or names none of their languages, and of texts of several languages."""
    names = F.create_map(*(F.lit(x) for code, all_ in NAMES.items() for n in all_ for x in (n, code)))
    named = F.try_element_at(names, F.split(F.lower(F.trim("label")), "[-_ ]")[0])
    per_text = languages.groupBy(key, "label").agg(F.collect_set("lang").alias("langs"))  # at most the languages known
    wrong = named.isNull() | ~F.array_contains("langs", named)
    return per_text.where((F.size("langs") > 1) | wrong).select(key, F.explode("langs").alias("lang"))
