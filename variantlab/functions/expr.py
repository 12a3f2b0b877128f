"""Column expressions: cells, tags, variants, residues, targets and feature names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean NULL, the residue alphabet, and residue properties.
NULL_CELLS = ("-", "None", "inf")
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
HYDROPATHY = {"I": 4.5, "V": 4.2, "L": 3.8, "F": 2.8, "C": 2.5, "M": 1.9, "A": 1.8, "G": -0.4, "T": -0.7, "S": -0.8, "W": -0.9, "Y": -1.3, "P": -1.6, "H": -3.2, "E": -3.5, "Q": -3.5, "D": -3.5, "N": -3.5, "K": -3.9, "R": -4.5, "X": 0.0, "B": 0.0}
VOLUME = {"I": 166.7, "V": 140.0, "L": 166.7, "F": 189.9, "C": 108.5, "M": 162.9, "A": 88.6, "G": 60.1, "T": 116.1, "S": 89.0, "W": 227.8, "Y": 193.6, "P": 112.7, "H": 153.2, "E": 138.4, "Q": 143.8, "D": 111.1, "N": 114.1, "K": 168.6, "R": 173.4, "X": 150.0, "B": 150.0}
RESIDUE_CLASSES = {
    "aliphatic": "ILV",
    "hydrophobic": "ILVMFYWHKTCAG",
    "aromatic": "FYWH",
    "positive": "HKR",
    "polar": "YWHKTCDESNQ",
    "negative": "DE",
    "charged": "HKRDE",
    "small": "PGCASNDTV",
    "tiny": "GCAS",
}
# The public BLOSUM62 substitution scores, rows and columns in the order of RESIDUES.
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


def blosum() -> list[list[int]]:
    return [[int(x) for x in line.split()] for line in BLOSUM62.strip().splitlines()]


def cell(text: Column) -> Column:
    """A cell without NULL literals; inner white space is kept, outer is not."""
    bare = F.trim(text)
    return F.when(~bare.isin(*NULL_CELLS) & (bare != ""), bare)


def as_real(text: Column) -> Column:
    """A number, NULL for NULL literals and for what isn't a number."""
    return cell(text).try_cast("double")


def as_text(value: Column) -> Column:
    """P02."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def wild_type(aac: Column) -> Column:
    return F.substring(aac, 1, 1)


def position(aac: Column) -> Column:
    """The 1-based position of a variant, NULL if there is none."""
    return F.regexp_extract(aac, r"^.(\d+).$", 1).try_cast("int")


def mutant(aac: Column) -> Column:
    return F.substring(aac, -1, 1)


def variant(wt: Column, pos: Column, mut: Column) -> Column:
    """P04."""
    return F.concat(wt, pos.cast("string"), mut)


def tag_values(tags: Column, target: str) -> Column:
    """The numbers of tags `target:value` or `target=value`; what doesn't split in exactly two, or is no number, is left out."""
    parts = F.filter(F.transform(F.split(tags, ","), lambda t: F.split(F.trim(t), "[:=]")), lambda p: (F.size(p) == 2) & (p[0] == target))
    return F.filter(F.transform(parts, lambda p: p[1].try_cast("double")), lambda x: x.isNotNull())


def tag_effect(tags: Column, target: str) -> Column:
    """P05 with a target tag: the mean of its numbers, NULL if there are none."""
    values = tag_values(tags, target)
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def tag_label(tags: Column) -> Column:
    """P05 without one: the last `label:` value."""
    labels = F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: t.startswith("label:"))
    return F.substring_index(F.element_at(F.when(F.size(labels) > 0, labels), -1), "label:", -1)


def root_target(target: Column) -> Column:
    """P07."""
    return F.sqrt(F.greatest(target, F.lit(0.0)))


def binarised(value: Column, threshold: float, flip: bool = False) -> Column:
    """P08."""
    low = value > threshold if flip else value < threshold
    return F.when(value.isNotNull(), F.when(low, 0).otherwise(1))


def warped_error(expected: Column, got: Column, power: float) -> Column:
    """The error with its sign and a power of its size."""
    return F.signum(expected - got) * F.pow(F.abs(expected - got), F.lit(power))


def combined_effect(effects: Column) -> Column:
    """One effect is itself; of more, the product of the two smallest, none below 0."""
    two = F.slice(F.sort_array(effects), 1, 2)
    product = F.aggregate(two, F.lit(1.0), lambda a, x: a * F.greatest(x, F.lit(0.0)))
    return F.when(F.size(effects) == 1, effects[0]).when(F.size(effects) > 1, product)


def additive_effect(effects: Column) -> Column:
    """P24's alternative: the sum of effects, each counted from 1."""
    return F.aggregate(effects, F.lit(0.0), lambda a, x: a + x) + 1 - F.size(effects)


def gap_penalty(train: Column, score: Column) -> Column:
    """P25: rewards a score and punishes the distance of the training score."""
    return F.pow(1 + score, F.lit(2.0)) - F.abs(train - score)


def cost_penalty(score: Column, features: Column, each: float, seconds: Column) -> Column:
    """P25: punishes features and run time, the latter by the logarithm of its hours."""
    return score - features * each - F.log(F.greatest(F.lit(1.0), seconds / 3600)) * 0.001


def exponent(x: float) -> float:
    """Ten to the power -x, and nothing from 30 on."""
    return 0.0 if x >= 30 else 10.0**-x


def clean_id(name: Column) -> Column:
    """An id fit for a file name."""
    return F.translate(name, "/,()", "____")


def canonical(name: Column) -> Column:
    """The id without its isoform."""
    return F.substring_index(name, "-", 1)


def residue_index(residue: Column) -> Column:
    """The place in RESIDUES, -1 for anything else."""
    return F.when(F.length(residue) == 1, F.instr(F.lit(RESIDUES), F.upper(residue)) - 1).otherwise(-1)


def standard_residues(sequence: Column) -> Column:
    """Rare residues replaced by the usual one next to them."""
    return F.translate(sequence, "UOJ", "CKI")


def looked_up(values: dict[str, float], key: Column) -> Column:
    """A value of a small fixed table."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def substitution(a: Column, b: Column) -> Column:
    """The BLOSUM62 score of two residues, either way round; NULL if one isn't standard."""
    flat = F.array(*[F.lit(x) for row in blosum() for x in row])
    i, j = residue_index(a), residue_index(b)
    return F.when((i >= 0) & (j >= 0), F.get(flat, i * 20 + j))


def residue_change(wt: Column, mut: Column) -> dict[str, Column]:
    """Differences of hydropathy and volume, and for each class whether the two residues agree on it."""
    out = {"hydropathy_change": looked_up(HYDROPATHY, mut) - looked_up(HYDROPATHY, wt), "volume_change": looked_up(VOLUME, mut) - looked_up(VOLUME, wt)}
    for name, members in RESIDUE_CLASSES.items():
        out[f"{name}_kept"] = (F.instr(F.lit(members), wt) > 0) == (F.instr(F.lit(members), mut) > 0)
    return out


def _settled(value: Column, places: Column) -> Column:
    """`value`, or where it looks like a tie at `places` decimals (0 to 22) the neighbour that its exact value rounds to, ties to even.

    Formatting rounds the shortest decimal text; the exact value may lie on the other side of a tie.
    The product with a power of ten is exact as a sum of two doubles.
    """
    power = F.get(F.array(*[F.lit(10.0**k) for k in range(23)]), places)
    half = lambda x: (x * F.lit(134217729.0)) - ((x * F.lit(134217729.0)) - x)
    size = F.abs(value)
    a, b = half(size), half(power)
    high = size * power
    low = ((a * b - high) + a * (power - b) + (size - a) * b) + (size - a) * (power - b)
    whole = F.floor(high).cast("double")
    side = (high - (whole + 0.5)) + low
    near = F.abs(high - (whole + 0.5)) < 1e-9 * F.greatest(high, F.lit(1.0))
    up = (side > 0) | ((side == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    return F.when(near, F.signum(value) * (whole + F.when(up, 1.0).otherwise(0.0)) / power).otherwise(value)


def shown(value: Column) -> Column:
    """A number with more digits the smaller it is, rounded from its exact value (below 1e-20 from its shortest decimal text)."""
    size = F.abs(value)
    small = (F.lit(2) - F.floor(F.log10(size))).cast("int")
    tiny = F.format_string("%.2e", F.when(small.between(0, 22), _settled(value, small)).otherwise(value))
    fixed = lambda k: F.format_string(f"%.{k}f", _settled(value, F.lit(k)))
    return F.when(value.isNull(), "None").when(size >= 100, F.format_string("%.0f", F.rint(value))).when(size >= 1, fixed(2)).when(size >= 0.001, fixed(4)).otherwise(tiny)


# Names of feature categories and sub-categories, categories of whole names, and rules by a
# part of the name, of which the first that fits counts.  Each gives a category and a sub-category or None.
EVOLUTIONARY, INTRA, SOLVENT, RIN, AMINO, PPI = "evolutionary", "intra contacts", "solvent access", "RIN centrality", "amino acid properties", "PPI contacts"
CONSERVATION, GEOMETRIC, NON_PPI, FLEXIBILITY, FUNCTION = "structural conservation", "geometric", "non-PPI contacts", "flexibility", "function type"
PROTEIN, CLASSIFICATION = "protein attributes", "structural classification"
TERTIARY, INTERACTION, CONSERVED, AGGREGATION = "Tertiary", "Interaction", "Structural conservation", "Aggregation"
CATEGORY_NAMES: dict[str, tuple[str, str | None]] = {
    "chain_dist": (PPI, INTERACTION),
    "phi": (GEOMETRIC, TERTIARY),
    "psi": (GEOMETRIC, TERTIARY),
    "dna_dist": (NON_PPI, INTERACTION),
    "ion_dist": (NON_PPI, INTERACTION),
    "b_factor": (FLEXIBILITY, TERTIARY),
    "metal_dist": (NON_PPI, INTERACTION),
    "oh_simple_class_Protein interaction": (PPI, AGGREGATION),
    "Blosum62": (AMINO, None),
    "Chemical distance": (AMINO, None),
    "KD mean": (AMINO, None),
    "Protein Size": (PROTEIN, None),
    "Relative Sequence Position": (AMINO, None),
    "Sequence Position Number": (PROTEIN, None),
    "Volume mean": (AMINO, None),
    "Mutant AA": (AMINO, None),
    "Wildtype AA": (AMINO, None),
    "simple_class": (CLASSIFICATION, AGGREGATION),
    "structural_classification": (CLASSIFICATION, AGGREGATION),
    "ssa": (GEOMETRIC, TERTIARY),
}
CATEGORY_PATTERNS: list[tuple[str, str, str | None]] = [
    ("GPW ref", EVOLUTIONARY, None),
    ("MSA smsa", EVOLUTIONARY, None),
    ("^gemme", EVOLUTIONARY, None),
    ("^.c (long|neigh|short)", INTRA, TERTIARY),
    ("^.c Protein", PPI, INTERACTION),
    ("^.c (Peptide|ligand|ion|DNA|RNA|metal)", NON_PPI, INTERACTION),
    ("^(lig_|rna_)", NON_PPI, INTERACTION),
    ("^oh_structural_classification", SOLVENT, AGGREGATION),
    ("^oh_ssa_", GEOMETRIC, TERTIARY),
    ("^oh_simple_class.*(Peptide|ligand|DNA|ion)", NON_PPI, AGGREGATION),
    ("^.c_rsa_", SOLVENT, AGGREGATION),
    ("(_rsa|surface_value)$|^rsa_|location", SOLVENT, TERTIARY),
    ("Centrality", RIN, AGGREGATION),
    (" change$", AMINO, None),
    (" AA_|^oh_AA ", AMINO, None),
    ("^(Site_|Backbone_|nof_site_|All_atom)", CONSERVATION, CONSERVED),
    ("^inter_chain_", PPI, INTERACTION),
    ("^intra_chain_", INTRA, TERTIARY),
    ("^oh_Function Type|^Function Type$", FUNCTION, None),
    ("^cis_|^ssbond_|ssbond$", GEOMETRIC, TERTIARY),
]


def _by_rules(name: Column, place: int) -> Column:
    out = None
    for text, found in CATEGORY_NAMES.items():
        out = (F if out is None else out).when(name == text, F.lit(found[place]))
    for pattern, *found in CATEGORY_PATTERNS:
        out = out.when(name.rlike(pattern), F.lit(found[place]))
    return out


def feature_category(name: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """The category of a feature by its name, NULL if no rule fits; `rules` of (start, part or end; text; category) instead of the usual ones."""
    if not rules:
        return _by_rules(name, 0)
    tests: dict[str, Callable[[str], Column]] = {"part": name.contains, "start": name.startswith, "end": name.endswith}
    out = None
    for kind, text, category in rules:
        hit = tests[kind](text)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


def feature_sub_category(name: Column) -> Column:
    """The sub-category, NULL where the category has none."""
    return _by_rules(name, 1)
