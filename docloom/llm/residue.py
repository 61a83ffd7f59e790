"""Problem 2: template residue, filler, error messages and script notices.

Every value is cut into messages: its sentences, its lines and the bracketed spans in it.
Addresses, dates and numbers are masked, and equal masked messages are grouped by exact
hash over all sources. A message is widely recurring if it stands in a given share of all
sources, more than once. Phrase and placeholder rules classify messages: broad word rules
and ambiguous brackets speak only about widely recurring ones, certain phrases about any.
A message that no rule has a word for would be grouped and then dropped, so it is left out
before the grouping; the rows are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

#: A message is widely recurring if it stands in this share of all sources, and in two rows.
WIDE_SHARE = 0.03
WIDE_ROWS = 2

# Phrases in the languages of the corpus, in lower case, numbers masked as 0.
ERROR_PHRASES = (
    r"access denied", r"zugriff verweigert", r"acc[eè]s refus[eé]", r"acceso denegado", r"accesso negato", r"(?:geen toegang|toegang geweigerd)",
    r"permission denied", r"you lack permission", r"keine berechtigung für diese",
    r"0 not found", r"page not found", r"seite nicht gefunden", r"page est introuvable", r"page introuvable", r"pagina non trovata",
    r"p[aá]gina no (?:existe|encontrada)", r"pagina (?:bestaat niet|niet gevonden)", r"angeforderte (?:adresse|seite) existiert nicht",
    r"internal server error", r"interner serverfehler", r"erreur interne du serveur", r"error interno del servidor", r"errore interno del server", r"interne serverfout",
    r"bad gateway", r"gateway time-?out", r"service (?:is )?(?:temporarily )?unavailable", r"vorübergehend nicht verfügbar", r"momentan[eé]ment indisponible",
    r"temporairement indisponible", r"momentaneamente non disponibile", r"temporaneamente non disponibile", r"temporalmente no disponible", r"no disponible temporalmente",
    r"servicio no disponible", r"tijdelijk niet (?:beschikbaar|bereikbaar)", r"session has expired", r"sitzung ist abgelaufen", r"session a expir[eé]", r"sesi[oó]n ha (?:caducado|expirado)",
    r"sessione [eè] scaduta", r"sessie is verlopen", r"rate limit (?:reached|exceeded)", r"too many requests", r"upstream connect error", r"err_[a-z]+_[a-z_]+",
    r"error establishing a database connection", r"connection (?:refused|timed out|reset by peer)", r"checking your browser", r"something went wrong on our",
    r"http error 0", r"0 forbidden",
)
FILLER_PHRASES = (
    r"lorem ipsum", r"blindtext:", r"dummy text", r"sample text", r"texte fictif", r"texto de relleno", r"testo segnaposto", r"opvultekst", r"body goes here",
    r"asdf qwert", r"xxx xxx", r"foo bar baz", r"todo todo",
)
SCRIPT_WORDS = r"javascript|js|scripts?|skripte|noscript"
SCRIPT_DEMANDS = (
    r"enable", r"turn on", r"switch on", r"switch it on", r"does not work without", r"is off", r"is disabled", r"aktivieren", r"eingeschaltet", r"benötigt", r"browser führt",
    r"activer", r"activez", r"requis", r"active javascript", r"activar", r"desactivad", r"attivare", r"attivi", r"disattivat", r"schakel", r"uitgeschakeld", r"zet ze aan", r"noscript",
)

# Broad rules, for widely recurring messages only: something is wrong with something on a screen, or a text stands in for another.
TROUBLE_WORDS = (
    r"errors?", r"failed", r"failure", r"unavailable", r"expired", r"denied", r"forbidden", r"maintenance", r"try again", r"refresh", r"reload", r"oops", r"blocked", r"log in", r"sign in",
    r"fehler", r"fehlgeschlagen", r"nicht erreichbar", r"abgelaufen", r"verweigert", r"wartungsarbeiten", r"erneut versuchen", r"versuchen sie es", r"neu laden", r"gesperrt", r"anmelden",
    r"erreur", r"échoué", r"indisponible", r"expirée?", r"refusée?", r"réessayez", r"rechargez", r"interdit", r"connectez-vous",
    r"fallado", r"caducad[ao]", r"expirad[ao]", r"denegad[ao]", r"inténtelo", r"vuelva a intentarlo", r"prohibido", r"inicie sesión",
    r"errore", r"non riuscit[ao]", r"scadut[ao]", r"negato", r"riprov\p{L}*", r"ricaric\p{L}*", r"vietato", r"acced\p{L}* di nuovo",
    r"fout", r"mislukt", r"onbereikbaar", r"verlopen", r"geweigerd", r"probeer het", r"opnieuw laden", r"verboden", r"inloggen",
)
SCREEN_WORDS = (
    r"web ?sites?", r"web ?pages?", r"servers?", r"browsers?", r"url", r"https?", r"cookies?", r"captcha", r"gateway", r"proxy", r"firewall", r"database", r"log-?in", r"webseiten?", r"internetseiten?", r"datenbank", r"seite neu",
    r"serveur", r"navigateur", r"page web", r"site web", r"servidor", r"navegador", r"página web", r"sitio web", r"pagina web", r"sito web", r"sito internet", r"webpagina", r"databank",
)
STAND_IN_WORDS = (
    r"placeholder", r"platzhalter(?:text)?", r"beispieltext", r"mustertext", r"example text", r"insert text", r"(?:your )?text (?:goes )?here", r"texte d'exemple", r"texte provisoire", r"texto de ejemplo", r"texto provisional",
    r"testo di esempio", r"testo provvisorio", r"voorbeeldtekst", r"plaatshouder", r"coming soon", r"under construction", r"no content yet", r"noch kein inhalt",
)

#: Spans that only templates write: {{x}}, {% x %}, ${x}, %%x%%, <<x>>, @@x@@, __X__
CERTAIN_SPAN = r"\{\{[^{}\n]{0,80}\}\}|\{%[^{}\n]{0,80}%\}|\$\{[^{}\n]{0,80}\}|%%\p{L}[\p{L}\d_]{0,40}%%|<<\p{L}[\p{L}\d_ ]{0,40}>>|@@\p{L}[\p{L}\d_]{0,40}@@|__(?<![\p{L}\d_]__)\p{Lu}[\p{Lu}\d_]{0,40}?__(?![\p{L}\d_])"
#: Spans that also occur otherwise: [X] (no link, no spelled-out address), <x> (no tag), «X» (one word), #X#
UNSURE_SPAN = r"\[(?!(?:at|dot|punkt|ät)\])\p{L}[\p{L}_ ]{1,40}\](?!\()|<(?!/?(?:html|head|title|body|h\d|p|br|b|i|a|div|span|noscript|script|table|tr|td|ul|li)\b)\p{L}[\p{L}_ ]{1,40}>|«\p{Lu}[\p{L}_]{1,40}»|#\p{Lu}[\p{Lu}_]{1,40}#"
#: A line of a form that was never filled in.
OPEN_FIELD = r"^[\p{L}_]{2,30}: ?(?:\.\.\.|\[\.\.\.\]|path/to/\S*)$|^(?:tbd|tba)$"


def masked(text: Column) -> Column:
    """Lower case, addresses as <at>, dates and other numbers as 0, white space as one blank."""
    bare = F.regexp_replace(F.lower(text), r"(?<!\S)(?:https?://\S{1,300}|www\.\S{1,300}|[^\s@]{1,100}@\S{1,200})", "<at>")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\d+(?:[.,:/\-]\d+)*", "0"), r"\s+", " "))


def _any(phrases: tuple[str, ...]) -> str:
    return r"(?<![\p{L}\d_])(?:" + "|".join(phrases) + ")"


def message_kind(message: Column) -> Column:
    """Rule that a masked sentence or line falls under, or null."""
    script = message.rlike(rf"(?<![\p{{L}}\d_])(?:{SCRIPT_WORDS})(?![\p{{L}}\d_])") & message.rlike("(?:" + "|".join(SCRIPT_DEMANDS) + ")")
    return (
        F.when(script, "script")
        .when(message.rlike(_any(ERROR_PHRASES)), "error")
        .when(message.rlike(_any(FILLER_PHRASES)), "filler")
        .when(message.rlike(OPEN_FIELD), "placeholder")
    )


def _words(words: tuple[str, ...]) -> str:
    return _any(words) + r"(?![\p{L}\d_])"


def broad_kind(message: Column) -> Column:
    """Kind that a masked message has if it recurs widely, or null."""
    return F.when(message.rlike(_words(SCREEN_WORDS)) & message.rlike(_words(TROUBLE_WORDS)), "error").when(message.rlike(_words(STAND_IN_WORDS)), "filler")


#: Some rule may speak about a sentence in lower case, numbers not yet masked, white space as it is.
_TRIGGER = (
    r"(?<![\p{L}\d_])(?:" + "|".join((*ERROR_PHRASES, *FILLER_PHRASES, SCRIPT_WORDS, *SCREEN_WORDS, *STAND_IN_WORDS)).replace("0 ", r"\d+ ").replace(" 0", r" \d").replace(" ", r"\s+")
    + r")|^\s*(?:tbd|tba|[\p{L}_]{2,30}:\s*(?:\.\.\.|\[\.\.\.\]|path/to/\S*))[\s\x{85}\x{2028}\x{2029}]*$"
)
_SPAN_MARK = "\x01"


def may_be_message(part: Column) -> Column:
    """Holds for every sentence or line whose masked form a rule speaks about, and for few others."""
    # The end of an address that is too long to mask whole begins a word in the masked form.
    return F.lower(part).rlike(_TRIGGER) | ((F.length(part) > 200) & part.rlike(r"\S{200}"))


def _found(values: DataFrame) -> DataFrame:
    """_key, _source, field, kind, certain, message for each message of a value that a rule speaks about; one pass over the text."""
    where = ["_key", "_source", "field"]
    spans = F.transform(F.regexp_extract_all("value", F.lit(f"{CERTAIN_SPAN}|{UNSURE_SPAN}"), F.lit(0)), lambda span: F.concat(F.lit(_SPAN_MARK), span))
    cut_up = values.select(*where, F.explode(F.concat(F.split("value", r"\n+|(?<=[.!?])\s+"), spans)).alias("part"))
    parts = cut_up.select(*where, "part", F.col("part").startswith(_SPAN_MARK).alias("is_span")).where(F.col("is_span") | may_be_message(F.col("part")))
    # The message of a span is the name in its brackets: one message however a template marks it.
    name = F.trim(F.regexp_replace(F.lower("part"), r"\|.*|[^\p{L}\d ]+", " "))
    parts = parts.select(*where, "part", "is_span", F.when(F.col("is_span"), name).otherwise(masked(F.col("part"))).alias("message"))
    parts = parts.select(*where, "part", "is_span", "message", F.when(~F.col("is_span"), message_kind(F.col("message"))).alias("sure"))
    certain = F.when(F.col("is_span"), F.col("part").rlike(CERTAIN_SPAN)).otherwise(F.col("sure").isNotNull())
    kind = F.when(F.col("is_span"), "placeholder").otherwise(F.coalesce("sure", broad_kind(F.col("message"))))
    return parts.select(*where, kind.alias("kind"), certain.alias("certain"), "message").where(F.col("kind").isNotNull())


def residue(df: DataFrame, key: str, fields: list[str], source: str, wide_share: float = WIDE_SHARE) -> DataFrame:
    """key, field, kind, message, path, n_rows, n_sources: the bad messages of each value, with the rows and sources that hold them.

    kind is placeholder, filler, error or script. path is 'recurring' for a message that
    stands in at least wide_share of all sources and in two rows, else 'phrase': a certain
    rule that needs no recurrence. The share does not depend on the size of the table. A
    span that a certain bracket marks anywhere is certain everywhere. Null and empty values
    have no messages; repeated rows count as rows; a null source is a source of its own.
    """
    own = F.coalesce(F.col(source), F.lit(""))
    values = df.select(F.col(key).alias("_key"), own.alias("_source"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("_f"))
    values = values.where(F.col("_f.value").isNotNull()).select("_key", "_source", "_f.field", "_f.value")
    found = cut(_found(values).distinct().withColumn("hash", F.xxhash64("kind", "message")))
    # Counts a source first, so that a hot message is many small groups; then over sources.
    by_source = found.groupBy("hash", "_source").agg(F.count("*").alias("n"), F.max("certain").alias("certain"))
    stats = by_source.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_sources"), F.max("certain").alias("sure_elsewhere"))
    sources = df.agg(F.count_distinct(own).alias("all_sources"))  # one row
    stats = stats.crossJoin(F.broadcast(sources)).withColumn("wide", (F.col("n_rows") >= WIDE_ROWS) & (F.col("n_sources") >= wide_share * F.col("all_sources")))
    kept = found.join(stats, "hash").where(F.col("wide") | F.col("certain") | F.col("sure_elsewhere"))
    return kept.select(F.col("_key").alias(key), "field", "kind", "message", F.when(F.col("wide"), "recurring").otherwise("phrase").alias("path"), "n_rows", "n_sources")


def without_residue(df: DataFrame, key: str, fields: list[str], bad: DataFrame) -> DataFrame:
    """key and fields of df, the values that `bad` lists (key, field) replaced by null."""
    flags = bad.groupBy(F.col(key).alias("_key")).agg(F.collect_set("field").alias("_bad"))  # at most len(fields) values
    joined = df.select(key, *fields).join(flags, F.col(key) == F.col("_key"), "left")
    clean = [F.when(F.coalesce(F.array_contains("_bad", f), F.lit(False)), F.lit(None)).otherwise(F.col(f)).alias(f) for f in fields]
    return joined.select(key, *clean)
