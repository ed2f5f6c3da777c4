"""Text rules shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a maximal run of letters and digits.
WORD = r"[\p{L}\p{N}]+"
#: WordPunct tokens: runs of letters, digits and underscores, and runs of other characters that are not blank.
BLANK = r"\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_PUNCT = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{BLANK}]+"

# Frequent function words by language and kind (articles and determiners, prepositions,
# conjunctions and particles, pronouns, auxiliary and modal verbs with common adverbs).
FUNCTION_WORDS = {
    "en": (
        "the a an this that these those its his her their our my your each every some any no all both most",
        "of in to for with from by at on into over under between before after since until near beside among about across through against without within",
        "and or but nor as if when while because although though than so not that whether once only",
        "it he she they we you i who whom which what where why how him them us me there nobody those one",
        "is are was were be been being has have had do does did will would can could may might must shall should never still also then now probably shortly first twice once today",
    ),
    "de": (
        "der die das den dem des ein eine einen einem einer eines kein keine dieser diese dieses jeder jede jedes viele",
        "in im an am auf aus bei mit nach von vom zu zum zur für über unter um durch gegen ohne vor hinter neben zwischen seit bis nahe ins etwa",
        "und oder aber denn weil obwohl dass ob wenn als wie auch nur noch nicht so sondern",
        "er sie es ich wir ihr ihn ihm ihnen ihnen man sich wer was wo wie dessen deren dafür danach davon daran",
        "ist sind war waren wird wurde wurden worden hat haben hatte hatten kann konnte muss musste soll sollte heute erstmals übrig schon immer hier",
    ),
    "fr": (
        "le la les l un une des du au aux ce cet cette ces son sa ses leur leurs mon ma mes chaque tout toute tous toutes quelques",
        "de d à en dans sur sous par pour avec sans entre vers chez depuis avant après près contre pendant jusque selon",
        "et ou mais donc ni car que qu si comme quand lorsque parce puisque ne n pas non plus",
        "il elle ils elles on je tu nous vous se s y qui quoi dont où lui leur eux cela ça c",
        "est sont était étaient fut furent être a ont avait avaient eut peut doit fait reste trouve très bien aussi encore toujours déjà peu deux fois",
    ),
    "es": (
        "el la los las un una unos unas este esta estos estas ese esa esos esas aquel aquella su sus mi mis cada todo toda todos todas algunos",
        "de del a al en con por para sin sobre entre hasta desde hacia tras según ante bajo contra durante cerca",
        "y e o u pero sino ni que si como cuando porque aunque pues no más",
        "él ella ellos ellas yo tú nosotros se lo le les me te nos quien quién qué cuál donde dónde nadie alguien allí",
        "es son era eran fue fueron ser está están estaba ha han había habían puede debe quedó dejó tiene muy también ya siempre aquí antes después dos veces",
    ),
}


def words(text: Column) -> Column:
    """The words of a text in lower case; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def n_tokens(text: Column) -> Column:
    """Number of WordPunct tokens; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PUNCT)), F.lit(0))
