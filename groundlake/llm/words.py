"""Fixed word lists of the text operators."""

#: fixed values: frequent function words per language
FUNCTION_WORDS = {
    "en": "the a an of to in on at by from with and or but if as is are was were be been has have had it its this that these those we our us i my he she they them their there not no so than then when while which who whose what why how will would can could should may do did does before after during over under again most very until into out up down about",
    "de": "der die das den dem des ein eine einen einem einer und oder aber wenn als ist sind war waren sein hat haben hatte wir uns unser ihr es er sie ich nicht kein keine so dann während bis in im an am auf aus bei mit nach von vom vor zu zum zur über unter durch für um trotz ohne also dass wie was warum wer bitte leider wieder noch nur auch",
    "fr": "le la les l un une des du de d et ou mais si est sont était étaient être a ont avait nous notre vous il elle ils elles je ce cette ces qui que qu quoi pourquoi ne pas en au aux dans sur sous par pour avec sans après avant pendant malgré près plus très aucune aucun se s n y comme",
    "es": "el la los las un una unos unas de del y o pero si es son fue fueron era ser ha han había se nos su sus lo le que quien qué por para con sin en al a sobre bajo entre después antes durante desde hasta no más muy como cuando favor alguien está quedó dentro cerca",
}
WORDS_OF = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
ALL_WORDS = frozenset().union(*WORDS_OF.values())
