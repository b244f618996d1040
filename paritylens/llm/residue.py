"""Problem 8: unfilled templates, filler, error pages and demands for scripts.

Documents are cut into lines and sentences.  Numbers, codes, addresses, dates
and names are masked.  Every distinct masked message that has a word of some
phrase rule is classified once; messages of one shape are grouped over all
documents and sources to see how widely they recur and what they stand beside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritylens.llm.words import WORD
from paritylens.session import cut_lineage, spread

#: Documents and sources over which a message recurs widely.
WIDE_DOCS, WIDE_SOURCES = 5, 2
#: A wide message is page furniture if this share of its documents has a notice or filler.
FURNITURE_SHARE = 0.8
#: Words that a title has at most once page furniture is taken off.
TITLE_WORDS = 4
#: Letters by which the words of the rules are known.
STEM = 6

# Words of the usual Latin filler text.
FILLER_WORDS = (
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu ex "
    "excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident "
    "qui quis reprehenderit sed sint sit sunt tempor ullamco ut velit veniam voluptate"
).split()
# Phrases of filler, of demands for scripts, of errors and of page
# furniture, each with words of which every match has at least one, known by
# their first six letters; then phrases of sentences that speak about placeholders.
FILLER = [
    ("text", r"\btext goes here\b"), ("content text", r"\b(your|sample|dummy|placeholder|filler) (content|text)\b.{0,30}(here|replace|before use)?"), ("content", r"\bcontent (goes )?here\b"), ("blindtext", r"\bblindtext\b"),
    ("contenu", r"\bcontenu (à venir|ici|factice)\b"), ("texto contenido", r"\b(texto|contenido) (de ejemplo|de relleno|aquí|próximamente)\b"), ("testo contenuto", r"\b(testo|contenuto) (segnaposto|di esempio|in arrivo|qui)\b"),
    ("beispieltext", r"\bbeispieltext\b"), ("steht kommt folgt", r"\bhier (steht|kommt|folgt) (der |ihr )?(text|inhalt)\b"), ("asdf qwer zxcv hjkl jkl yuio foo bar baz", r"\b((asdf|qwer|zxcv|hjkl|jkl|yuio|foo|bar|baz)\W+){3,}"), ("lorem", r"\blorem ipsum\b"),
]
SCRIPTS = [
    ("javascript scripts", r"\b(enable|activate|turn on|allow|requires?|need)\b.{0,30}\b(java ?script|scripts|scripting)\b"), ("javascript scripts", r"\b(java ?script|scripts|scripting)\b.{0,40}\b(is|are|must be|has to be)\b.{0,20}\b(required|needed|disabled|enabled|turned off|on)\b"),
    ("scripts", r"\bturn(ed)? (on|off) scripts?\b"), ("scripting", r"\bscripting (turned off|disabled|enabled)\b"), ("javascript scripts", r"\bwithout (java ?script|scripts|scripting)\b"), ("javascript skripte", r"\b(aktivieren|einschalten)\b.{0,20}\b(java ?script|skripte?)\b"), ("javascript skripte", r"\b(java ?script|skripte?)\b.{0,30}\b(aktivieren|einschalten|erforderlich)\b"),
    ("javascript", r"\b(activer|active[rz]?|activar|habilit\w+|attivar[ei]?|attiva|abilit\w+)\b.{0,20}\bjava ?script\b"), ("javascript", r"\bjava ?script\b.{0,30}\b(requis|nécessaire|necesario|richiesto|necessario|desactivado|disattivato|désactivé)\b"),
    ("scripts", r"\bscripts and cookies must be on\b"), ("browser", r"\bchecking your browser\b"),
]
ERRORS = [
    ("404 403 401 410 429 500 502 503 504", r"\b(404|403|401|410|429|500|502|503|504)\b.{0,4}(not found|forbidden|unauthori[sz]ed|gone|bad gateway|service unavailable|gateway time-?out|internal server error|too many requests|access denied)"),
    ("error fehler erreur", r"^(http |[\p{L}]+ portal )?(error|fehler|erreur|errore)\W*(code )?[45]\d\d\b"), ("err", r"\berr_[a-z_]+\b"), ("error", r"\binternal server error\b"), ("unavailable", r"\bservice (temporarily )?unavailable\b"), ("gateway found forbidden denied requests", r"^([\p{L}-]+ ){0,3}(\d{3}\W*)?(bad gateway|not found|forbidden|access denied|too many requests)\W*$"),
    ("found located", r"\b(requested )?page (could not be|was not|cannot be) (found|located)\b"), ("located", r"\bcould not be located on this server\b"), ("available", r"\bpage is no longer available\b"), ("took", r"\bsite took too long\b"), ("down", r"\bserver is down\b"), ("maintenance", r"\bdown for maintenance\b"),
    ("later", r"\btry again later\b"), ("contact", r"\bcontact the site owner\b"), ("permission", r"\bdo not have permission to (view|access)\b"), ("expired", r"\bsession has expired\b"), ("sign", r"\bplease sign in again\b"), ("gateway", r"\bgateway timeout: upstream\b"), ("upstream", r"\bupstream did not answer\b"), ("upstream", r"\binvalid response\b.{0,30}\bupstream\b"),
    ("traceback", r"\btraceback \(most recent call last\)"), ("render request query", r"\b(render|request|query) failed\b.{0,40}\b(missing|context|error)\b"), ("template", r"\btemplate context missing\b"), ("slow", r"\bslow down and retry\b"), ("gefunden", r"\bseite (wurde )?nicht gefunden\b"), ("angeforderte", r"\bangeforderte (adresse|seite)\b"), ("melden", r"\bmelden sie sich erneut an\b"), ("sitzung", r"\bsitzung ist abgelaufen\b"),
    ("introuvable", r"\bpage introuvable\b"), ("erreur", r"\berreur (\d{3})?\W*retour\b"), ("session", r"\bsession a expiré\b"), ("encontrada", r"\bpágina no encontrada\b"), ("error", r"\berror interno del servidor\b"), ("intentarlo", r"\bvuelva a intentarlo más tarde\b"), ("sesión", r"\bsesión ha caducado\b"), ("trovata", r"\bpagina non trovata\b"), ("errore", r"\berrore interno\b"), ("riprova", r"\briprova più tardi\b"), ("error fehler erreur", r"^(errore|error|fehler|erreur) \d{3}\W*$"), ("timeout", r"^gateway timeout\W*$"),
]
FURNITURE = [
    ("menu reload loading search log login sign cookie privacy skip back", r"\b(menu|reload|loading|search|log ?in|sign (in|up)|cookie settings|privacy policy|skip to (main )?content|back to (start|home|top))\b"), ("home", r"\bhome( > [\p{L}]+)+"), ("request trace incident ray reference error", r"\b(request|trace|incident|ray|reference|error) (id )?#"), ("node", r"\bat [\p{L}]+ node\b"),
    ("nginx", r"\bnginx[\p{L}-]*( gateway)?( [\p{L}]+)?"), ("help", r"\bcontact the [\p{L}]+ help ?desk\b"), ("copyright", r"(©|\bcopyright\b).{0,60}$"),
]
MENTION = [
    r"\bplace ?holders?\b", r"\bplatzhalter\w*\b", r"\bmarcador(es)? de posición\b", r"\bsegnaposto\b", r"\bespaces? réservés?\b", r"\btemplates?\b", r"\bvorlagen?\b", r"\bplantillas?\b", r"\bmodèles? de\b", r"\bstyle ?guide\b", r"\bmail merge\b", r"\bserienbrief\w*\b",
    r"\b(square|curly|angle) (brackets|braces)\b", r"\bliterals?\b", r"\brenderer\b", r"\bparser\b", r"\bsyntax\b", r"\bregex\b", r"\bvariables?\b", r"\bescaped?\b",
]
HTML_TAGS = (
    "a abbr address article aside audio b base blockquote body br button canvas caption center cite code col dd del details div dl dt em embed fieldset figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param pre q s samp script section select small source span "
    "strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
# End of the value list.

_NAME = r"[\p{L}][\p{L}\p{Nd}_ .-]{0,40}"
#: Marks that can hardly be anything else, and marks that need a field's name.
STRONG = rf"\{{\{{ ?{_NAME} ?\}}\}}|<<{_NAME}>>|\$\{{ ?{_NAME} ?\}}|(?<!\$)\{{{_NAME}\}}|@@{_NAME}@@|%[\p{{L}}_]{{2,40}}%|\[\[{_NAME}\]\]|(?<![\p{{L}}\p{{Nd}}%])%[sd](?![\p{{L}}\p{{Nd}}])|(?<![\p{{L}}\p{{Nd}}_])_{{3,}}(?![\p{{L}}\p{{Nd}}_])|(?<![\p{{L}}\p{{Nd}}])X{{3,}}(?![\p{{L}}\p{{Nd}}])"
WEAK = rf"(?<!\[)\[{_NAME}\](?![\](])|(?<!<)<{_NAME}>(?!>)|(?<![\p{{L}}\p{{Nd}}_])__[\p{{L}}][\p{{L}}\p{{Nd}}_]{{0,40}}?__(?![\p{{L}}\p{{Nd}}_])"

#: A program that leaves a mark as it stands: the sentence is about the mark.
KEPT = rf"(?i)\b(system|program|software|tool|script|form|editor|converter|importer)s? (keep|leave|show|print|store|display)s? [\"'“‘]?(?-i:{STRONG}|{WEAK})[\"'”’]? (as (it is|is|they are)|unchanged|verbatim|literally|unfilled)\b"

_MARKED = r"[{}\[\]<>%@_]|XXX"


def _any(rules: list) -> str:
    return "(" + "|".join(r if isinstance(r, str) else r[1] for r in rules) + ")"


def _stems(*rules: list[tuple[str, str]]) -> list[str]:
    """Beginnings of the words without which none of the rules matches."""
    return sorted({w[:STEM] for some in rules for words, _ in some for w in words.split()})


def _field(mark: Column) -> Column:
    """Letters of a placeholder's name."""
    return F.lower(F.regexp_replace(mark, r"[^\p{L}\p{Nd}]", ""))


def messages(text: Column) -> Column:
    """Lines and sentences of a text."""
    # A blank comes first in every branch, so most characters fail at once.
    return F.filter(F.split(text, r"\n+|\s+\|\s+|\s(?<=[.!?]\s)\s*(?=[\p{Lu}<{\[@$%_\"'(>#*-]|\p{Ll}{2,}\b)"), lambda x: F.trim(x) != "")


def masked(message: Column) -> Column:
    """A message with numbers, codes, dates and addresses as # , in lower case."""
    x = F.when(message.contains("://") | message.contains("@") | message.contains("www."), F.regexp_replace(message, r"https?://\S+|www\.\S+|\S+@\S+\.\p{L}{2,}", "#")).otherwise(message)
    x = F.when(message.rlike(r"\p{Nd}"), F.regexp_replace(x, r"(?<![\p{L}\p{Nd}])\p{Lu}{0,4}-?\p{Nd}{4,}[\p{Nd}/.:-]*(?<![.:/-])|\p{Nd}+/\p{Nd}+", "#")).otherwise(x)
    return F.lower(F.when(message.rlike(r"\s[\s&&[^ ]]|[\s&&[^ ]]|  "), F.regexp_replace(x, r"\s+", " ")).otherwise(x))


def shape(message: Column) -> Column:
    """What equal messages share: also without placeholders, short numbers and names."""
    x = F.when(message.rlike(_MARKED), F.regexp_replace(message, rf"{STRONG}|{WEAK}", "¤")).otherwise(message)
    x = F.when(message.rlike(r"\p{Nd}"), F.regexp_replace(x, r"(?<![\p{L}\p{Nd}])\p{Lu}{0,4}-?\p{Nd}[\p{Nd}/.:-]*(?<![.:/-])", "#")).otherwise(x)
    return F.lower(F.regexp_replace(x, r"\p{Lu}(?<![\p{L}\p{Nd}].)\p{Ll}{2,}(?!\p{L})", "n"))


def residue(df: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """(id, why) of the documents to exclude: ``placeholder``, ``filler``, ``error`` or ``script``.

    A document with at least one placeholder in a sentence of its own is a
    case; so is one that consists of notices or filler with or without page
    furniture and titles.  Null and empty texts are no cases; rows without an id are left out.  A repeated row
    has one row here.
    """
    docs = spread(df.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))).withColumn("k", F.xxhash64("text"))
    parts = cut_lineage(_message_rows(docs))
    holds = _with_placeholders(parts)
    # Each phrase rule runs once for each distinct form that has a word of some rule.
    forms = parts.where("form is not null").select("f", "form").distinct()
    kinds = cut_lineage(forms.select("f", _kind(F.col("form")).alias("kind")).where("kind is not null"))
    slim = parts.select("id", "k", "source", "h", "f", "n", "filler", F.col("form").isNotNull().alias("asked"))
    # Only documents with a notice or filler can consist of one.
    noticed = slim.where("asked").join(kinds, "f", "left_semi").select("id", "k").unionByName(slim.where("filler").select("id", "k")).distinct()
    whole = slim.join(noticed, ["id", "k"], "left_semi").join(kinds, "f", "left")
    kind = F.when(F.col("filler"), "filler").otherwise(F.col("kind"))
    whole = cut_lineage(whole.select("id", "k", "h", F.col("n").alias("n_words"), kind.alias("kind")))
    furniture = _furniture(slim, kinds, whole)
    unknown = F.col("kind").isNull() & (F.col("n_words") > TITLE_WORDS)
    judged = whole.join(furniture, "h", "left").groupBy("id", "k").agg(F.max(unknown & F.col("beside").isNull()).alias("other"), F.max(F.when(F.col("kind").isNotNull(), F.struct("n_words", "kind"))).alias("most"))
    consists = judged.where("not other").select("id", F.col("most.kind").alias("why"))
    return holds.select("id", F.lit("placeholder").alias("why")).unionByName(consists).groupBy("id").agg(F.min("why").alias("why"))


def _message_rows(docs: DataFrame) -> DataFrame:
    """(id, k, source, h, f, n, filler, form, strong, weak, mention), one row for each message.

    ``h`` stands for its shape, ``f`` for its masked form, which is kept only
    where it has a word of some phrase rule; ``n`` counts its words without
    page furniture, which is taken off wherever it stands in a message.
    """
    marks = F.array_distinct(F.regexp_extract_all("message", F.lit(f"({STRONG})"), F.lit(1)))
    weak = F.filter(F.array_distinct(F.regexp_extract_all("message", F.lit(f"({WEAK})"), F.lit(1))), lambda x: ~(F.substring(x, 1, 1).eqNullSafe("<") & _field(x).isin(HTML_TAGS)))
    about = F.lower("message").rlike(_any(MENTION)) | F.col("message").rlike(KEPT)
    has = lambda *rules: lambda w: F.substring(w, 1, STEM).isin(_stems(*rules))
    left = F.size(F.regexp_extract_all(F.regexp_replace("form", _any(FURNITURE), " "), F.lit(f"({WORD})"), F.lit(1)))
    # Each select uses the columns of the one before, so none is computed twice.
    rows = docs.select("id", "k", "source", F.explode(messages(F.col("text"))).alias("message")).withColumn("message", F.trim("message"))
    rows = rows.withColumns({"marked": F.col("message").rlike(_MARKED), "form": masked(F.col("message")), "shape": shape(F.col("message"))})
    rows = rows.withColumn("words", F.regexp_extract_all("form", F.lit(f"({WORD})"), F.lit(1)))
    latin = F.size(F.filter("words", lambda w: w.isin(FILLER_WORDS)))
    rows = rows.withColumns({"asked": F.exists("words", has(FILLER, SCRIPTS, ERRORS)), "framed": F.exists("words", has(FURNITURE)) | F.col("form").contains("©"), "latin": latin})
    named = F.size(F.filter("words", lambda w: w.rlike(r"\p{L}")))
    return rows.select(
        "id", "k", "source", F.xxhash64("shape").alias("h"), F.xxhash64("form").alias("f"), F.when(F.col("framed"), left).otherwise(F.size("words")).alias("n"),
        # At least three words, four fifths of them filler.
        F.coalesce(F.when(F.col("latin") >= 3, F.col("latin") * 5 >= named * 4), F.lit(False)).alias("filler"),
        F.when(F.col("asked"), F.col("form")).alias("form"),
        F.when(F.col("marked"), marks).alias("strong"), F.when(F.col("marked"), weak).alias("weak"), F.coalesce(F.when(F.col("marked"), about), F.lit(False)).alias("mention"),
    )


def _kind(form: Column) -> Column:
    """What a masked message is by its phrases; null for none of them."""
    return F.when(form.rlike(_any(FILLER)) & ~form.rlike(_any(MENTION)), "filler").when(form.rlike(_any(SCRIPTS)), "script").when(form.rlike(_any(ERRORS)), "error")


def _with_placeholders(parts: DataFrame) -> DataFrame:
    """(id) of documents with a placeholder in a sentence that does not write about marks.

    Only the sentence itself tells that it writes about marks, however often it recurs.
    """
    marked = parts.where("strong is not null").select("id", "strong", "weak", "mention")
    # Names of fields, as the plain marks of the whole corpus give them.
    fields = marked.select(F.explode("strong").alias("mark")).select(_field(F.col("mark")).alias("field")).where("length(field) > 1").distinct()
    strong = marked.where("size(strong) > 0 and not mention").select("id")
    weak = marked.where("size(weak) > 0 and not mention").select("id", F.explode("weak").alias("mark")).withColumn("field", _field(F.col("mark")))
    sure = F.regexp_replace("mark", "^__|__$", "").contains("_") | F.col("mark").rlike(r"(?i)^[<\[_]+\s*(insert|enter|your|add|fill|todo)\b")
    return strong.unionByName(weak.where(sure).select("id")).unionByName(weak.where(~sure).join(fields, "field", "left_semi").select("id")).distinct()


def _furniture(slim: DataFrame, kinds: DataFrame, whole: DataFrame) -> DataFrame:
    """(h, beside) of wide messages that stand beside notices in most of their documents.

    Counted over the members of a shape that are no notices themselves.
    """
    asked = whole.where(F.col("kind").isNull() & (F.col("n_words") > TITLE_WORDS)).select("h").distinct()
    plain = slim.where("not filler").join(asked, "h", "left_semi").join(kinds, "f", "left_anti")
    # One row for each document first, so that only counts per source meet.
    per_source = plain.select("h", "source", "id", "k").distinct().groupBy("h", "source").agg(F.count(F.lit(1)).alias("n"))
    spans = per_source.groupBy("h").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_sources")).where((F.col("n_docs") >= WIDE_DOCS) & (F.col("n_sources") >= WIDE_SOURCES))
    near = whole.where("kind is null").select("h", "id", "k").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return near.join(spans, "h").where(F.col("n") >= FURNITURE_SHARE * F.col("n_docs")).select("h", F.lit(True).alias("beside"))
