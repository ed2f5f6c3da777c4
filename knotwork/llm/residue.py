r"""Template residue, filler and error pages among descriptions.

Texts are cut into segments, and segments are sorted into a prefix tree of fixed depth: number of tokens, then the
first ``DEPTH`` tokens, with ``<*>`` for what holds a digit and ``<name>`` for the record's own name. Inside a leaf those
segments are similar that agree in all words of the closed classes (function words and words of evidence); other words
are parameters of the template. Templates are judged once, by the weight of general evidence against the other content;
verdicts go back to the segments, and from them to the records. Unresolved slots are looked for
separately, in the records themselves, since a slot may stand in an otherwise ordinary text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.text import FUNCTION_WORDS
from knotwork.session import Workspace

DEPTH = 4
ANY, OWN, PARAMETER, SLOT_PATH = "<*>", "<name>", "<?>", "<slot>"
_CUT = "\ue002"
#: Where a segment ends: after a sentence mark, at line ends, at tags of blocks.
_BOUNDARY = r"(?i)[.!?…](?=[\s\x{00A0}(])|[\r\n]|</?(?:p|br|div|span|li|b|i|em|strong)\s*/?>"

_SLOT = r"[\p{L}][\p{L}\p{N}]*(?:[._-][\p{L}\p{N}]+)*"
#: HTML elements, which are markup and no slots.
HTML = "a|abbr|article|b|big|blockquote|body|br|center|cite|code|col|dd|del|div|dl|dt|em|font|footer|gallery|h1|h2|h3|h4|h5|h6|head|header|hr|html|i|img|ins|kbd|li|main|math|nav|nowiki|ol|p|poem|pre|q|ref|references|s|samp|section|small|span|strike|strong|sub|sup|table|tbody|td|th|thead|tr|tt|u|ul|var|wbr"
#: Unresolved slots, one regular expression each; all ignore case.
SLOTS = (
    rf"\{{\{{\s*{_SLOT}\s*(?:\|\s*{_SLOT}\s*)?\}}\}}",
    rf"(?<!\{{)\{{\s*{_SLOT}\s*\}}",
    rf"\[\[\[\s*{_SLOT}\s*\]\]\]",
    rf"(?<!\[)\[\s*(?:insert|your|enter|add)\s[^\]\[]{{1,60}}\]",
    rf"(?<!\[)\[(?!P\d)(?!(?:citation|edit|note|sic|when|who|where|which|by|clarification|update|verification)\b){_SLOT}\](?!\])",
    rf"\(\s*(?:your\s+)?{_SLOT}(?:\s{_SLOT})?\s+goes\s+here\s*\)",
    rf"\$\{{[^}}\s]{{1,60}}\}}",
    rf"(?<![\p{{N}}$])\$(?!\p{{N}}){_SLOT}\$",
    rf"%\(\s*{_SLOT}\s*\)s",
    rf"(?<![\p{{N}}%])%{_SLOT}%",
    rf"(?<![\p{{L}}\p{{N}}#]){'#'}{_SLOT}#",
    rf"@@\s*{_SLOT}\s*@@",
    rf"(?<![\p{{L}}\p{{N}}_])__{_SLOT}(?:_{_SLOT})*__(?![\p{{L}}\p{{N}}_])",
    rf"(?<![\p{{L}}\p{{N}}:]):{_SLOT}:(?![\p{{L}}\p{{N}}:])",
    r"<%=?\s*[^%>]{1,60}%>",
    rf"(?:<<|&lt;&lt;)\s*{_SLOT}\s*(?:>>|&gt;&gt;)",
    rf"(?:<|&lt;)\s*(?:your\s|insert\s|enter\s)\s*[^<>&]{{1,60}}(?:>|&gt;)",
    # A capitalised word in angle brackets is a name.
    rf"(?:<|&lt;)(?!/?(?:{HTML})\b)(?-i:(?!\p{{Lu}}\p{{L}}*\p{{Ll}})){_SLOT}(?:>|&gt;)",
)
#: What every slot holds one of; it clears most texts at once.
SLOT_HINT = r"(?i)[{\[$%#@_:<]|&lt;|goes\s+here"
SLOT = "(?i)" + "|".join(f"(?:{s})" for s in SLOTS)

# Public vocabulary of pages, failures, requests to the reader and texts still to be written, in English,
# German, French and Spanish. A word is evidence by itself; no sentence is listed.
MEDIUM = (
    "page pages site sites website webpage browser server servers database host network connection request requests query link address url uri account session resource resources content service module backend upstream "
    "gateway script scripts scripting javascript js noscript cookie cookies app application version settings code status http https token quota key reader viewer client search view privacy ray xid id ref reference number copy "
    "seite seiten dienst skript skripte verbindung anfrage inhalt konto sitzung datenbank serveur contenu navigateur requête connexion compte lien página sitio servidor navegador contenido conexión cuenta enlace solicitud referencia"
).split()
FAULT = (
    "error errors erreur fehler exception unhandled failed fails failure denied forbidden unauthorized unauthorised restricted blocked unavailable available disabled unsupported expired suspended removed broken damaged missing gone bad "
    "timeout timed refused rejected exceeded invalid wrong went oops sorry warning problem internal null undefined traceback nothing found matched returned cannot could redirects many longer incident fatal required necessary off "
    "gefunden deaktiviert ausgeschaltet verweigert gesperrt abgelaufen erreichbar existiert vorübergehend introuvable refusé interdit désactivé désactivés indisponible nécessaire accessible chargé trop temps répondre "
    "denegado acceso prohibido desactivado desactivados deshabilitado encontrada encontrado disponible necesario pudo"
).split()
REQUEST = (
    "you your our please try again reload refresh retry read wait waiting enable activate allow accept turn turned switch switched sign log prove verify verifying checking human robot captcha continue loading load loaded maintenance use "
    "support supported requires needs rely works newer update upgrade administrator notified moment permission access welcome call recent "
    "veuillez vous votre activer autoriser activez afficher continuer charger bitte sie ihr ihre ihren aktivieren erlauben einschalten fortzufahren laden favor active activar habilitar habilite permitir continuar cargar"
).split()
STUB = (
    "todo fixme tbd tba placeholder dummy sample untitled lorem filler description descriptions summary text texts entry record item sentence sentences paragraph editor short pending later soon coming follows added entered yet here add write enter "
    "insert replace fill describe beschreibung folgt fehlt kürze später steht hier texte compléter venir ici descripción pendiente redactar resumen aquí"
).split()
EVIDENCE = tuple(dict.fromkeys(MEDIUM + FAULT + REQUEST + STUB))
#: Words that make a message of a segment even where they are its only content.
TELLING = tuple(
    "error errors erreur fehler exception denied forbidden unauthorized unauthorised unavailable timeout timed found gone sorry oops denegado verweigert refusé introuvable expired loading traceback todo fixme tbd tba placeholder dummy untitled "
    "lorem fill pending noscript undefined null captcha".split()
)
#: Marks of open tasks; at the beginning of a segment they weigh as much as two further words.
TASKS = ("fixme", "tbd", "tba")
#: Tokens of keyboard tests.
JUNK = tuple("bla blah text test dummy foo bar baz qux asd asdf asdfg asdfgh asdfghjkl qwe qwer qwert qwerty zxcv yxcv jkl hjkl xyz abc sample blub tralala".split())
_LINKING = "out off via ms like looks seems something".split()

#: Fixed words of filler texts in invented Latin.
LATIN = (
    "ad adipiscing aliqua aliquam amet animet consectetur consequat consera cum cursus delum diam dictum do dolor dolore duis ea eget eiusmod elit enim erat eros est et eu ex felis fermus fusce habita "
    "id in incididunt ipsum justo labore laoreet lectus libero lorem luctora luctus magna magnora malorem massa mauris metus mi minim morbi nec nibh nisi non nostra nostrud nulla nullam nunc odio orci orcinus "
    "ornare pellentesque pellora per pharetra porta portica praesel purus quam quibus quis risus sapien sed sedane sem semper sit sodales suscipit tellus tempor tempora tempus tincidunt tortor turpis ullamco ullanis "
    "ultrices urna ut varius vel velit velut veniam vestibulum vestor vitae vitus viverra volutpat vulputate"
).split()


CLOSED = tuple(dict.fromkeys([w for kinds in FUNCTION_WORDS.values() for part in kinds for w in part.split()] + _LINKING))
_FUNCTION = tuple(w for w in CLOSED if w not in set(EVIDENCE))
_MARKS = (ANY, OWN)
_FAULT_WORD = "(error|exception)$"
_RUN_OF_X = "^x{2,}$"


def _among(token: str, *words: str) -> str:
    """SQL that tells whether a token is one of the words, a lookup in one set."""
    return f"{token} IN ({', '.join(repr(w) for w in dict.fromkeys(words))})"


_SHOWN = f"({_among('x', *EVIDENCE)} OR x RLIKE '{_FAULT_WORD}')"
#: What a template keeps behind its first tokens.
_KEPT = f"(i < {DEPTH} OR {_among('x', *CLOSED, *EVIDENCE, *JUNK, *LATIN, ANY, OWN)} OR x RLIKE '{_FAULT_WORD}' OR x RLIKE '{_RUN_OF_X}')"
_TEMPLATE = f"array_join(transform(split(s, ' '), (x, i) -> CASE WHEN {_KEPT} THEN x ELSE '{PARAMETER}' END), ' ')"
#: Distinct words of evidence, other content, and the two kinds of keyboard filler, of the tokens ``t`` of a template.
_WEIGHT = f"(size(array_distinct(filter(t, x -> {_SHOWN}))) + CASE WHEN {_among('get(t, 0)', *TASKS)} THEN 2 ELSE 0 END)"
_OTHER = f"size(filter(t, x -> NOT ({_among('x', *EVIDENCE, *_FUNCTION, ANY, OWN)} OR x RLIKE '{_FAULT_WORD}')))"
_TELLING = f"exists(t, x -> {_among('x', *TELLING)} OR x RLIKE '{_FAULT_WORD}')"
_KEYBOARD = f"((size(t) > 1 AND forall(t, x -> {_among('x', *JUNK)})) OR (length(array_join(t, '')) >= 3 AND forall(t, x -> x RLIKE '{_RUN_OF_X}')))"
#: Words of evidence outweigh the rest: at least two of them, or a telling one alone. Numbers, the record's own name and function words say nothing.
_MESSAGE = f"(({_WEIGHT} >= 2 AND {_OTHER} < {_WEIGHT}) OR ({_WEIGHT} = 1 AND {_OTHER} = 0 AND {_TELLING}) OR {_KEYBOARD})"
#: At least three words, and at least four fifths of the words, are those of filler Latin, two of them longer ones.
_FILLER = (
    f"(size(t) >= 3 AND size(filter(t, x -> {_among('x', *LATIN)})) >= 0.8 * size(t) AND size(array_distinct(filter(t, x -> {_among('x', *[w for w in LATIN if len(w) > 4])}))) >= 2)"
)


def _tokens(text: Column) -> Column:
    """Lower-case tokens, each behind a single blank, ``<*>`` for tokens that hold a digit; ends of segments stay, as tokens."""
    bare = F.regexp_replace(F.concat(F.lit(" "), F.lower(text)), rf"[^\p{{L}}\p{{M}}\p{{N}}{_CUT}]+", " ")
    return F.regexp_replace(F.replace(bare, F.lit(_CUT), F.lit(f" {_CUT} ")), r"(?<= )[^ \p{N}]*+\p{N}[^ ]*+", ANY)


def segments(text: Column, name: Column | None = None) -> Column:
    """Sentences and lines of a text, each as tokens between single blanks; the record's own ``name`` becomes ``<name>``."""
    cut = F.regexp_replace(F.replace(text, F.lit(_CUT), F.lit(" ")), _BOUNDARY, _CUT)
    plain = F.concat(_tokens(F.replace(cut, F.lit("&nbsp;"), F.lit(" "))), F.lit(" "))
    if name is not None:
        own = F.rtrim(_tokens(F.coalesce(F.replace(name, F.lit(_CUT), F.lit(" ")), F.lit(""))))
        # A name of one character, or none, is replaced by what cannot occur.
        plain = F.replace(plain, F.when(F.length(own) > 2, F.concat(own, F.lit(" "))).otherwise(F.lit("\n")), F.lit(f" {OWN} "))
    return F.filter(F.transform(F.split(plain, _CUT), lambda s: F.trim(F.regexp_replace(s, "  +", " "))), lambda s: s != "")


def templates(paths: DataFrame) -> DataFrame:
    """``template, n_segments, verdict`` of one row per segment (``template``): each template is judged once.

    ``verdict`` is ``message``, ``filler`` or null.
    """
    found = paths.groupBy("template").agg(F.count(F.lit(1)).alias("n_segments")).withColumn("t", F.split("template", " "))
    return found.withColumn("verdict", F.expr(f"CASE WHEN {_MESSAGE} THEN 'message' WHEN {_FILLER} THEN 'filler' END")).drop("t")


def has_slot(text: Column) -> Column:
    return F.regexp_like(text, F.lit(SLOT_HINT)) & F.regexp_like(text, F.lit(SLOT))


def paths(df: DataFrame, key: str, field: str, name: str | None = None) -> DataFrame:
    """``key, template``: one row per segment of each text, and one with the template ``<slot>`` for a text with a slot.

    The template of a segment is its path in the tree: number of tokens (which it keeps), first ``DEPTH`` tokens, then the words of
    the closed classes and ``<?>`` for each other word. It depends on no other segment.
    """
    own = df[name].alias("own") if name else F.lit(None).cast("string").alias("own")
    texts = df.select(df[key].alias("key"), df[field].alias("txt"), own).where("txt is not null").withColumn("slotted", has_slot(F.col("txt")))
    bare = F.when(F.col("slotted"), F.regexp_replace("txt", SLOT, " ")).otherwise(F.col("txt"))
    cut = texts.select("key", "slotted", segments(bare, F.col("own") if name else None).alias("segs"))
    both = f"concat(transform(segs, s -> {_TEMPLATE}), CASE WHEN slotted THEN array('{SLOT_PATH}') ELSE CAST(array() AS array<string>) END)"
    return cut.select("key", F.explode(F.expr(both)).alias("template"))


def residue(df: DataFrame, key: str, field: str, name: str | None = None) -> DataFrame:
    """One row per record with residue: ``key`` and ``kinds``, a sorted array of ``filler``, ``message`` and ``slot``.

    ``name`` is the column with the record's own name, which counts neither for nor against a message. Null and blank texts
    have no residue; a record counts once however many segments are residue; repeated rows with one key are one record. Very
    long texts are read whole. An empty table gives an empty result; only key, text and name are read. Whether a record has
    residue depends on that record alone: templates are shared, but no other row changes the template of a segment.
    """
    work = Workspace(df.sparkSession, "residue")
    held = work.write(paths(df, key, field, name), "paths")
    bad = templates(held.where(F.col("template") != SLOT_PATH)).where("verdict is not null").select("template", "verdict")
    by_template = held.join(bad, "template").select("key", F.col("verdict").alias("kind"))
    by_slot = held.where(F.col("template") == SLOT_PATH).select("key", F.lit("slot").alias("kind"))
    return by_template.unionByName(by_slot).groupBy("key").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).withColumnRenamed("key", key)


def without_residue(df: DataFrame, key: str, field: str, name: str | None = None) -> DataFrame:
    """The rows whose text has no residue; rows with a null key stay."""
    return df.join(residue(df, key, field, name).select(key), key, "left_anti")
