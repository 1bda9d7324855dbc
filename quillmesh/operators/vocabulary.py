"""Rule tables of the research network. A rule is data; tables of a user's own replace these.

Names, categories, patterns and labels below are fixed values: results must carry them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .network import Rule

# Term rules as (name, category, patterns), in the order in which they are tried.
TERM_RULES = (
    Rule("SH2 mechanism", "mechanism", (r"\bSH2\b", r"homolytic substitution")),
    Rule("homolytic substitution", "mechanism", (r"homolytic substitution",)),
    Rule("reductive elimination", "mechanism", (r"reductive elimination",)),
    Rule("radical recombination", "mechanism", (r"radical recombination", r"\brecombination\b")),
    Rule("radical cross-coupling", "mechanism", (r"radical .*cross-coupling", r"cross-coupling .*radical")),
    Rule("radical capture", "mechanism", (r"trap organic radicals", r"radical trap", r"radical capture")),
    Rule("single electron transfer", "mechanism", (r"single[- ]electron", r"\bSET\b")),
    Rule("oxidative addition", "mechanism", (r"oxidative addition",)),
    Rule("decarbonylation", "mechanism", (r"decarbonylation", r"decarbonylative")),
    Rule("decarboxylation", "mechanism", (r"decarboxylation", r"decarboxylative")),
    Rule("photoelectrochemistry", "method", (r"photoelectro", r"photo-electro")),
    Rule("photoredox catalysis", "method", (r"photoredox", r"photocatalysis")),
    Rule("electrochemistry", "method", (r"electrochem", r"electrode", r"electrocatal")),
    Rule("C(sp3)-C(sp3) cross-coupling", "method", (r"C\(sp3\)\s*[- ]\s*C\(sp3\)", r"Csp ?3.*Csp ?3")),
    Rule("cross-coupling", "method", (r"\bcross-coupling\b", r"coupling reaction")),
    Rule("nickel catalyst", "catalyst", (r"\bnickel\b", r"\bNi/photoredox\b", r"\bNi-catal")),
    Rule("chiral nickel catalyst", "catalyst", (r"enantioselective.*nickel", r"chiral.*nickel", r"pyridine-oxazoline")),
    Rule("palladium catalyst", "catalyst", (r"\bpalladium\b", r"\bPd\b")),
    Rule("bismuth radical", "catalyst", (r"\bbismuth\b", r"bismuth\(II\) radical")),
    Rule("alkyl radical", "chemical", (r"alkyl radical",)),
    Rule("alkylnickel intermediate", "chemical", (r"alkylnickel", r"organonickel")),
    Rule("carboxylic acid", "reactant", (r"carboxylic acid",)),
    Rule("carboxylic acid ester", "reactant", (r"carboxylic acid ester",)),
    Rule("alkyl halide", "reactant", (r"alkyl halide", r"alkyl iodide")),
    Rule("aziridine", "reactant", (r"aziridine",)),
    Rule("acetal", "reactant", (r"acetal",)),
    Rule("alkene", "reactant", (r"\balkene\b",)),
    Rule("radical flux", "concept", (r"radical concentration", r"radical flux", r"radical generation rate", r"current density")),
    Rule("stereocontrol", "concept", (r"enantioselective", r"stereochemistry", r"stereocontrol", r"\bee\b")),
    Rule("electrode-catalyst decoupling", "concept", (r"electrode.*oxidation state", r"heterogeneous electrode", r"photoredox catalyst or.*electrode")),
    Rule("N-alpha carbon radical", "concept", (r"N.?alpha", r"N-alpha", r"alpha-amino", r"α-amino")),
)

# Evidence methods; their category as nodes is "concept".
EVIDENCE_RULES = (
    Rule("DFT", "concept", (r"\bDFT\b", r"density functional")),
    Rule("cyclic voltammetry", "concept", (r"\bCV\b", r"cyclic voltam")),
    Rule("radical clock", "concept", (r"radical clock",)),
    Rule("stoichiometric intermediate", "concept", (
        r"stoichiometric.{0,80}intermediate", r"intermediate.{0,80}stoichiometric", r"isolat(?:ed|ion).{0,80}intermediate", r"intermediate.{0,80}isolat(?:ed|ion)",
        r"trapp(?:ed|ing).{0,80}intermediate", r"intermediate.{0,80}trapp(?:ed|ing)", r"characteri[sz](?:ed|ation).{0,80}intermediate", r"intermediate.{0,80}(?:NMR|crystal|X-ray|EPR)",
    )),
    Rule("control experiment", "concept", (r"control experiment",)),
    Rule("sequential addition", "concept", (r"sequential addition", r"order of addition")),
    Rule("Stern-Volmer", "concept", (r"Stern[- ]Volmer",)),
    Rule("EPR", "concept", (r"\bEPR\b",)),
)

# Pairs of terms whose articles contrast.
CONTRASTS = (("SH2 mechanism", "reductive elimination"), ("nickel catalyst", "palladium catalyst"))

# Fixed values: (id, concepts) of questions, and (id, question, concepts) of experiments; their prose is the caller's.
QUESTIONS = (
    ("RQ1", ("nickel catalyst", "alkyl radical", "alkylnickel intermediate", "radical flux")),
    ("RQ2", ("SH2 mechanism", "homolytic substitution", "reductive elimination", "stereocontrol")),
    ("RQ3", ("radical flux", "stereocontrol", "photoredox catalysis", "electrochemistry")),
    ("RQ4", ("electrode-catalyst decoupling", "electrochemistry", "nickel catalyst", "chiral nickel catalyst")),
    ("RQ5", ("single electron transfer", "carboxylic acid ester", "radical flux", "cross-coupling")),
    ("RQ6", ("radical capture", "radical recombination", "cross-coupling", "alkyl radical")),
)
EXPERIMENTS = (
    ("EX1", "RQ2", ("radical clock", "SH2 mechanism")),
    ("EX2", "RQ1", ("stoichiometric intermediate", "nickel catalyst")),
    ("EX3", "RQ5", ("cyclic voltammetry", "single electron transfer")),
    ("EX4", "RQ3", ("electrochemistry", "radical flux")),
    ("EX5", "RQ6", ("radical recombination", "cross-coupling")),
    ("EX6", "RQ2", ("stereocontrol", "SH2 mechanism")),
)

# Folder of a category's notes.
CATEGORY_FOLDERS = {"mechanism": "Mechanisms", "method": "Methods", "catalyst": "Catalysts", "reactant": "Reactants", "chemical": "Chemicals", "concept": "Concepts"}


def rules_from(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table (rule_no, name, category, patterns); vocabularies are small, so they are read to the driver."""
    return tuple(Rule(r["name"], r["category"], tuple(r["patterns"])) for r in table.select("rule_no", "name", "category", "patterns").orderBy("rule_no").collect())


# Canonical terms as (name, patterns), in their order; the last value says that case counts.
CANONICAL_RULES = (
    Rule("photoelectrocatalysis", "canonical", (r"\bphotoelectrocatalysis\b",)),
    Rule("photoelectrochemical catalysis", "canonical", (r"\bphotoelectrochemical catalysis\b",)),
    Rule("photoredox catalysis", "canonical", (r"\bphotoredox catalysis\b",)),
    Rule("electrochemistry", "canonical", (r"\belectrochemistr(?:y|ies)\b",)),
    Rule("nickel catalysis", "canonical", (r"\bnickel catalysis\b", r"\bnickel[- ]cataly[sz]ed\b", r"\bNi[- ]cataly[sz]ed\b", r"\b(?:chiral\s+)?nickel catalyst\b")),
    Rule("redox-active ester", "canonical", (r"(?i:\bredox[- ]active esters?\b)", r"\bRAEs?\b", r"(?i:\bNHPI esters?\b)", r"(?i:\bN[- ]hydroxyphthalimide esters?\b)"), True),
    Rule("alkyl halide", "canonical", (r"\balkyl halides?\b",)),
    Rule("alkyl bromide", "canonical", (r"\balkyl bromides?\b",)),
    Rule("alkyl chloride", "canonical", (r"\balkyl chlorides?\b",)),
    Rule("carboxylic acid", "canonical", (r"\bcarboxylic acids?\b",)),
    Rule("single electron transfer", "canonical", (r"(?i:\bsingle[- ]electron transfer\b)", r"(?<![A-Za-z])SET(?![A-Za-z])"), True),
    Rule("SH2", "canonical", (r"\bSH2\b", r"\bS\s+H\s+2\b"), True),
    Rule("homolytic substitution", "canonical", (r"\bhomolytic substitution\b",)),
    Rule("radical cross-coupling", "canonical", (r"\bradical cross[- ]coupling\b",)),
    Rule("radical mechanism", "canonical", (r"\bradical mechanisms?\b",)),
    Rule("cross-coupling", "canonical", (r"\bcross[- ]coupling\b",)),
    Rule("C(sp3)-C(sp3) cross-coupling", "canonical", (r"\bC\s*\(\s*sp\s*3\s*\)\s*[-–—]\s*C\s*\(\s*sp\s*3\s*\)\s+cross[- ]coupling\b",)),
    Rule("C(sp3) chemistry", "canonical", (r"\bC\s*\(\s*sp\s*3\s*\)\s+chemistry\b",)),
    Rule("iron porphyrin", "canonical", (r"\biron porphyrin\b", r"\bFe porphyrin\b")),
    Rule("cobalt catalyst", "canonical", (r"\bcobalt catalysts?\b",)),
    Rule("iridium photocatalyst", "canonical", (r"\biridium photocatalysts?\b",)),
    Rule("asymmetric catalysis", "canonical", (r"\basymmetric catalysis\b",)),
    Rule("enantioselective", "canonical", (r"\benantioselective\b",)),
    Rule("decarboxylative coupling", "canonical", (r"\bdecarboxylative coupling\b",)),
    Rule("decarboxylative functionalization", "canonical", (r"\bdecarboxylative functionali[sz]ation\b",)),
)
