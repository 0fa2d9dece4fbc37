"""Word lists, patterns and parameters of question understanding and evidence gating.

Fixed values: results depend on exactly these strings, numbers and their order.
"""

from __future__ import annotations

SYNONYMS = {
    "biosafety": ["bsl", "bio", "bio-safety"],
    "bsl": ["biosafety"],
    "level": ["lvl"],
    "laboratory": ["lab"],
    "lab": ["laboratory"],
    "cabinet": ["hood", "bsc"],
    "hood": ["cabinet", "bsc"],
    "autoclave": ["steam", "sterilizer", "pressure", "cooker"],
    "sterilization": ["decontamination", "disinfection"],
    "ppe": ["protective", "equipment"],
    "respirator": ["mask"],
}
INTENT_STOPWORDS = (
    "what is are the a an of in on at to for with how why when where who which does do did can could should would will define definition meaning explain tell me about please you i we they this that these those"
).split()
FILTER_STOPWORDS = "what is are the a an of define definition please tell me about explain meaning".split()
CONCEPT_STOPWORDS = "level a the is are by of in on to for".split()
INTENT_PATTERNS = [
    ("definition", r"what (?:is|are|does|do)\s+(?:the\s+)?(.+?)(?:\?|$)"),
    ("definition", r"define\s+(.+?)(?:\?|$)"),
    ("definition", r"definition of\s+(.+?)(?:\?|$)"),
    ("definition", r"meaning of\s+(.+?)(?:\?|$)"),
    ("comparison", r"difference between\s+(.+?)\s+and\s+(.+?)(?:\?|$)"),
    ("comparison", r"compare\s+(.+?)\s+(?:and|with|to)\s+(.+?)(?:\?|$)"),
    ("comparison", r"(.+?)\s+vs\.?\s+(.+?)(?:\?|$)"),
    ("procedure", r"how to\s+(.+?)(?:\?|$)"),
    ("procedure", r"steps (?:to|for)\s+(.+?)(?:\?|$)"),
    ("procedure", r"procedure (?:for|to)\s+(.+?)(?:\?|$)"),
    ("procedure", r"process (?:of|for)\s+(.+?)(?:\?|$)"),
    ("explanation", r"how (?:does|do)\s+(.+?)\s+work"),
    ("explanation", r"why (?:is|does|do|are)\s+(.+?)(?:\?|$)"),
    ("explanation", r"explain\s+(.+?)(?:\?|$)"),
    ("explanation", r"reason (?:for|why)\s+(.+?)(?:\?|$)"),
    ("fact_lookup", r"where (?:is|are|does|do)\s+(.+?)(?:\?|$)"),
    ("fact_lookup", r"when (?:is|are|does|do)\s+(.+?)(?:\?|$)"),
    ("fact_lookup", r"which\s+(.+?)(?:\?|$)"),
    ("fact_lookup", r"who\s+(.+?)(?:\?|$)"),
    ("yesno", r"^(?:is|are|can|does|do|should|will|would)\s+(.+?)(?:\?|$)"),
]
HEADING_PATTERNS = [
    r"^(?:technique|method|procedure|process)\s+(?:for|of|to)\s+.+$",
    r"^(?:preparation|collection|examination|detection|identification|measurement|testing|staining|fixation|washing|incubation|sterilization|disinfection)\s+(?:of|for|with|using)\s+.+$",
    r"^(?:preparing|collecting|examining|detecting|identifying|measuring|testing|staining|fixing|washing|incubating|sterilizing|disinfecting)\s+.+$",
]
SHORT_TERMS = ["bsl", "ppe", "who", "cdc", "fda"]
ENTITIES = [
    "biosafety", "bsl", "containment", "level", "risk group", "ppe", "protective equipment", "glove", "mask", "respirator", "gown", "autoclave", "sterilization", "disinfection",
    "laboratory", "reagent", "specimen", "culture", "refrigerator", "freezer", "storage", "microscope", "centrifuge", "incubator", "pregnancy test", "test kit", "diagnostic",
]
DEFINITIONAL = [" is defined as", " refers to ", " is a ", " are ", " means ", " definition ", " is the ", " are the ", " known as "]
EVIDENCE = {
    "definition": (DEFINITIONAL, r"\blevel\s+\d+\s+laborator", "definitional language"),
    "procedure": (["step ", "procedure", "method", "how to", "should be", "must be", "process", "first", "then", "next", "finally"], None, "procedural steps or instructions"),
    "comparison": (["difference", "differ", "compared", "versus", "vs", "contrast", "unlike", "while", "whereas", "both"], None, "comparative language"),
    "fact_lookup": ([], r"\d+|\b(where|when|located|at)\b", "explicit facts or values"),
    "explanation": (["because", "due to", "reason", "cause", "result", "since", "therefore", "thus", "consequently"], None, "explanatory language"),
    "yesno": (["yes", "no", "can", "cannot", "does", "does not", "is ", "is not", "required", "optional", "mandatory"], None, "explicit affirmation or negation"),
}
INDICATORS = {
    "containment": r"\bcontainment\b",
    "containment_level": r"\bcontainment level\b",
    "ppe": r"\b(ppe|personal protective equipment|protective gear|protective equipment)\b",
    "respiratory": r"\b(respiratory protection|respirator|breathing apparatus)\b",
    "restricted": r"\b(restricted access|restricted area|limited access|access control)\b",
    "biosafety_cabinet": r"\b(biosafety cabinet|safety cabinet|biological safety cabinet|bsc)\b",
    "decontamination": r"\b(decontamination|disinfection|sterilization|autoclave)\b",
    "aerosol": r"\b(aerosol|airborne|droplet|inhalation|aerosol generation)\b",
    "level_1": r"\b(level 1|bsl-?1|biosafety level 1)\b",
    "level_2": r"\b(level 2|bsl-?2|biosafety level 2)\b",
    "level_3": r"\b(level 3|bsl-?3|biosafety level 3)\b",
    "level_4": r"\b(level 4|bsl-?4|biosafety level 4)\b",
}
ALIASES = {
    "biosafety": ["bsl", "bio-safety", "biological safety"],
    "biosafety level": ["bsl level", "bsl", "containment level"],
    "biosafety level 1": ["bsl-1", "bsl 1", "level 1"],
    "biosafety level 2": ["bsl-2", "bsl 2", "level 2"],
    "biosafety level 3": ["bsl-3", "bsl 3", "level 3"],
    "biosafety level 4": ["bsl-4", "bsl 4", "level 4"],
    "biosafety cabinet": ["bsc", "biological safety cabinet", "safety cabinet"],
    "ppe": ["protective equipment", "protection"],
    "autoclave": ["steam sterilization", "pressure cooker"],
    "sterilization": ["decontamination", "disinfection"],
}
#: Section: (first page, last page, keywords, keywords of neighbouring entities).
SECTIONS = {
    "biosafety": (70, 260, ["biosafety", "bsl", "containment", "risk group", "risk assessment"], ["biosafety", "bsl", "containment"]),
    "ppe": (20, 180, ["ppe", "protective equipment", "gown", "mask", "glove", "respirator"], ["ppe", "protective equipment", "glove", "mask", "respirator"]),
}
SEMANTIC_RULES = {
    "ppe": (
        ["personal protective equipment", "ppe", "protective equipment", "protection equipment", "protective gear"],
        ["glove", "gown", "coat", "mask", "goggle", "face shield", "respirator", "apron", "shoe cover", "head cover", "eye protection"],
        ["microscope", "centrifuge", "balance", "refrigerator", "incubator", "autoclave", "pipette", "freezer", "shaker", "analyzer"],
    ),
    "biosafety_levels": (["biosafety level", "bsl", "containment level"], ["level 1", "level 2", "level 3", "level 4", "bsl", "containment"], []),
}
#: Intent: (top k, weight of dense and of lexical score, share of hybrid and of graph score).
INTENT_PARAMETERS = {
    "definition": (15, 0.7, 0.3, 0.8, 0.2),
    "explanation": (20, 0.6, 0.4, 0.7, 0.3),
    "comparison": (25, 0.5, 0.5, 0.6, 0.4),
    "procedure": (20, 0.4, 0.6, 0.7, 0.3),
    "fact_lookup": (12, 0.5, 0.5, 0.7, 0.3),
    "yesno": (10, 0.6, 0.4, 0.8, 0.2),
}
STORAGE_WORDS = ["refrigerator", "reagent", "reagents", "pregnancy", "keep", "storage", "store"]
ROLE_PROCEDURE = ["step ", "procedure", "method", "how to", "should be", "must be", "process"]
ROLE_EXAMPLE = ["for example", "e.g.", "such as", "example:", "instance"]
BUNDLE_ROLES = [
    ("definition", ["is defined as", "is classified as", "refers to", "means", "consists of"]),
    ("procedure", ["procedure", "step", "follow these", "must be"]),
    ("example", ["example", "for example", "such as"]),
]
QUESTION_PREFIXES = ["what is", "what are", "definition of", "define", "meaning of", "what does"]
DEFINING_VERBS = r"\b(is|are|refers?\s+to|defined\s+as|means?|consists?\s+of)\b"
NOT_FOUND = "Not found in the provided documents."
