"""The wordings that rules of the core look for, written out for SQL alone, and sentences that hit or miss them.

Nothing here comes from the column functions: an entry that is missing or wrong
on either side shows in the comparison.
"""

from __future__ import annotations

# Word lists and patterns, as they are documented; patterns without their word bounds.
ENFORCEMENT = "klage|klager|bøde|bøder|sanktion|sanktioner|håndhævelse|håndhæv|enforcement|complaint|penalt|fine|sanction|remedy|redress|tilsyn|myndighed|myndigheder|kompetent myndighed|påbud|anke|appel|klagevej|erstatning|kompensation"
STRONG = "krav|kræves|kræver|forventes|dokumentation|teknisk dokumentation|requirements|hvad skal vi|skal vi|hvordan|must|should|controls|forpligt|forpligtelser|ret til|retten til|indsigtsret|hvordan overholder|hvordan efterlever|overholde|efterleve|implementer|implementere|indføre|etablere"
WEAK = "foranstaltninger|tekniske og organisatoriske|procedure|politik|kontrol|governance|frister|dokumentere|logning|rapportering"
VERBS = "krav|kræver|kræves|skal|must|should|hvordan|overhold|efterlev|implement"
CLASSIFICATION = "klassific|classification|kategori|annex|bilag|risikoklasse|klassificeres|forbudt|prohibited|højrisiko|high-risk|high risk"
SCOPE = "omfattet|omfattes|omfatter|anvendelsesområde|finder anvendelse|falder ind under|falder under|falder det under|ind under|gælder for|gælder forordningen|scope|applicability|applies|shall apply|covered by|subject to|within the scope"
DEFINITIONS = "definitioner|definitions|for the purposes of this regulation|i denne forordning forstås|means|begreber|definition"
STRUCTURE = "indholdsfortegnelse|toc|table of contents|oversigt|struktur|hvilke kapitler|hvilke artikler|liste over|oversigt over"
NORMATIVE = r"skal|b[øo]r|m[åa]\s*ikke|maa\s+ikke|kr[æa]ver|kraever|forpligtet|p[åa]kr[æa]vet|pligt|must|shall|should|required|may\s*not"
QUERY_INTENT = [("ENFORCEMENT", "penalty|penalties|fine|fines|sanction|sanctions|authority|myndighed|bøde|bøder"), ("TRANSPARENCY", r"inform|tell\s+user|ui|disclosure|transparency|gennemsigtighed|oplysn|information"), ("OBLIGATIONS", r"what\s+must|must|shall|required|requirements|krav|skal")]
COMPARISON = [r"versus|vs\.?|differences?\s+between|forskelle?n?\s+mellem|sammenlign|sammenlignet\s+med", r"(?:compare|comparing)(?:[^\p{L}\p{N}_\n]|[^\p{L}\p{N}_\n][^\n]*[^\p{L}\p{N}_\n])and", r"how\s+doe(?:s)?(?:[^\p{L}\p{N}_\n]|[^\p{L}\p{N}_\n][^\n]*[^\p{L}\p{N}_\n])compare"]
ROUTING = r"which\s+law|what\s+law\s+(?:cover|covers|govern|governs|applies|regulate|regulates)|which\s+regulation|which\s+eu\s+regulation|what\s+legislation|identify\s+law|identify\s+the\s+law|hvilken\s+lov|hvad\s+lov|hvilken\s+forordning"
AGGREGATION = r"all\s+laws?|all\s+eu\s+laws?|every\s+law|across\s+laws?|across\s+eu\s+laws?|each\s+law|all\s+regulations?|all\s+eu\s+regulations?|what\s+do\s+laws?\s+say|what\s+do\s+eu\s+laws?\s+say|alle\s+love|hver\s+lov|på\s+tværs\s+af\s+love"
EVIDENCE = [
    ("FORBIDDEN", "forbud|forbudte|prohibited|forbidden"),
    ("ENFORCEMENT", "håndhævelse|sanktion|sanktioner|bøde|bøder|klage|tilsyn|markedsovervåg|complaint|enforcement|market surveillance|surveillance authority|supervision|penalt|fine|sanction|remedy|redress"),
    ("DEFINITION", "definition|definitions|definitioner|begreb|begreber|forstås ved|means|shall mean"),
    ("SCOPE", "anvendelsesområde|scope|applicability|definition|definitions|omfang"),
    ("CLASSIFICATION", "højrisiko|high-risk|high risk|klassific|classification|annex|bilag|kategori"),
]

#: Sentences for the rules; each list above is hit and missed by some.
SAID = [
    "Hvad siger kapitel 3 om dette?", "Hvad handler artikel 5 om?", "Sammenfat k a p i t e l IV nu.", "Opsummer a r t i k e l 12 b, tak.", "Giv en oversigt over reglerne.", "TABLE OF CONTENTS please", "Hvilke artikler er der?",
    "Vi bør vente.", "De MAA IKKE gå.", "Loven kraever det.", "Det kræver tid.", "It may not pass.", "Mayor Mustard shoulders it.", "Pligten er klar.", "Det er en pligt.", "Han er påkrævet, ikke påkrævede.",
    "forbud mod dette", "forbudt og andet", "Kontrol og frister skal være klare.", "Kontrol og frister uden mere.", "Der er tilsyn.", "A fine was redress enough.", "Er jeg omfattet?", "Bilag og kategori", "Højrisiko systemer", "Begreber og definitioner", "It means this.",
    "Compare A and B.", "compareåand this", "Comparing one\nand two.", "A vs. B", "A vs B", "bvs b", "Differences between these.", "difference  between those", "How does it compare?", "How doe it compare?", "Forskellen mellem dem", "Forskelle mellem dem", "sammenlignet med det", "sammenligning",
    "Which law is it?", "Which EU regulation?", "What law governs this?", "What law govern this?", "What law apply here?", "identify law", "Hvilken forordning?", "hvilken  lovgivning", "All EU laws.", "all laws", "Across laws", "what do eu law say", "På tværs af love", "alle loven",
    "Penalties are due.", "The authorityless one.", "Tell  user now", "ui", "guidance", "requirement", "requirements", "Intet her.", "",
]


def listed(words: str) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words.split("|")) + "]"


def holds(words: str, text: str = "text") -> str:
    """SQL: does the lower-cased text contain one of the words?"""
    return f"len(list_filter({listed(words)}, lambda w: contains(lower({text}), w))) > 0"


def stands(pattern: str, text: str = "text") -> str:
    """SQL: does the lower-cased text hold the pattern between non-word characters?"""
    return f"regexp_matches(lower({text}), '(^|[^\\p{{L}}\\p{{N}}_])({pattern})($|[^\\p{{L}}\\p{{N}}_])')"


def said(key: str) -> str:
    """SQL: the sentence for a row's key."""
    quoted = ", ".join("'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for s in SAID)
    return f"[{quoted}][(({key}) % {len(SAID)} + 1)::INT]"
