"""Genetic codes: which codon means what, which are stops, and how to choose a code."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values, from NCBI's list of genetic codes: amino acids of the standard code
#: for codons in the order T, C, A, G of each base.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Each code's name, where it differs from the standard one, its start codons besides ATG, and its context-dependent stops.
CODES = {
    1: ("Standard", "", "TTG CTG", ""),
    2: ("Vertebrate Mitochondrial", "AGA=* AGG=* ATA=M TGA=W", "ATA ATT ATC GTG", ""),
    3: ("Yeast Mitochondrial", "ATA=M CTT=T CTC=T CTA=T CTG=T TGA=W", "ATA GTG", ""),
    4: ("Mold/Protozoan/Mycoplasma", "TGA=W", "TTA TTG CTG ATT ATC ATA GTG", ""),
    5: ("Invertebrate Mitochondrial", "AGA=S AGG=S ATA=M TGA=W", "TTG GTG ATA ATT ATC", ""),
    6: ("Ciliate/Dasycladacean/Hexamita", "TAA=Q TAG=Q", "", ""),
    9: ("Echinoderm/Flatworm Mitochondrial", "AAA=N AGA=S AGG=S TGA=W", "GTG", ""),
    10: ("Euplotid Nuclear", "TGA=C", "", ""),
    11: ("Bacterial/Archaeal/Plastid", "", "TTG CTG ATT ATC ATA GTG", ""),
    12: ("Alternative Yeast Nuclear", "CTG=S", "CTG", ""),
    13: ("Ascidian Mitochondrial", "AGA=G AGG=G ATA=M TGA=W", "TTG GTG ATA", ""),
    14: ("Alternative Flatworm Mitochondrial", "AAA=N AGA=S AGG=S TAA=Y TGA=W", "", ""),
    16: ("Chlorophycean Mitochondrial", "TAG=L", "", ""),
    21: ("Trematode Mitochondrial", "TGA=W ATA=M AAA=N AGA=S AGG=S", "GTG", ""),
    22: ("Scenedesmus obliquus Mitochondrial", "TCA=* TAG=L", "", ""),
    23: ("Thraustochytrium Mitochondrial", "TTA=*", "ATT GTG", ""),
    24: ("Rhabdopleuridae Mitochondrial", "AGA=S AGG=K TGA=W", "GTG CTG TTG", ""),
    25: ("Candidate Division SR1/Gracilibacteria", "TGA=G", "GTG TTG", ""),
    26: ("Pachysolen tannophilus Nuclear", "CTG=A", "CTG", ""),
    33: ("Cephalodiscidae Mitochondrial", "TAA=Y AGA=S AGG=K TGA=W", "GTG TTG", ""),
    27: ("Karyorelict Nuclear", "TAA=Q TAG=Q", "", "TAA TAG"),
    28: ("Condylostoma Nuclear", "TAA=Q TAG=Q TGA=W", "", "TAA TAG TGA"),
    31: ("Blastocrithidia Nuclear", "TAA=E TAG=E TGA=W", "", "TAA TAG"),
}
DEFAULT = 11
#: The stops with names of their own.
STOP_NAMES = {"TAA": "ochre", "TAG": "amber", "TGA": "opal"}
#: IUPAC nucleotide letters and the bases they stand for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
CODONS = tuple(map("".join, product("TCAG", repeat=3)))


@dataclass(frozen=True)
class GeneticCode:
    id: int
    name: str
    amino: dict[str, str]
    stops: tuple[str, ...]
    alt_starts: tuple[str, ...]
    ambiguous_stops: tuple[str, ...]

    @property
    def all_starts(self) -> tuple[str, ...]:
        return ("ATG", *self.alt_starts)

    def translate(self, codon: str) -> str:
        return self.amino.get((codon or "").upper(), "X")


@lru_cache(maxsize=None)
def genetic_code(table_id: int | None) -> GeneticCode:
    """The code with this NCBI id; the default one for an unknown id."""
    key = table_id if table_id in CODES else DEFAULT
    name, changes, starts, ambiguous = CODES[key]
    amino = dict(zip(CODONS, STANDARD)) | dict(x.split("=") for x in changes.split())
    return GeneticCode(key, name, amino, tuple(c for c in CODONS if amino[c] == "*"), tuple(starts.split()), tuple(ambiguous.split()))


def stop_set(table_id: int | None) -> dict[str, str]:
    """The definite stops and their names."""
    return {c: STOP_NAMES.get(c, "stop") for c in genetic_code(table_id).stops}


def ambiguous_stop_set(table_id: int | None) -> dict[str, str]:
    """Stops that depend on context; the scan never calls them."""
    return {c: "ambiguous" for c in genetic_code(table_id).ambiguous_stops}


def resolved_stops(stops: dict[str, str]) -> dict[str, str]:
    """All IUPAC codons of which every reading is a stop, with the name its readings share, else ``stop``."""
    out = dict(stops)
    for letters in product(IUPAC, repeat=3):
        names = {stops.get("".join(c)) for c in product(*(IUPAC[x] for x in letters))}
        if None not in names:
            out.setdefault("".join(letters), names.pop() if len(names) == 1 else "stop")
    return out


def codes_frame(spark: SparkSession) -> DataFrame:
    """The codes in display order: ``ord, table_id, name, stops, starts, ambiguous_stops``."""
    rows = [(k, c.id, c.name, list(c.stops), list(c.all_starts), list(c.ambiguous_stops)) for k, c in enumerate(map(genetic_code, CODES), 1)]
    return spark.createDataFrame(rows, "ord int, table_id int, name string, stops array<string>, starts array<string>, ambiguous_stops array<string>")


def codon_frame(spark: SparkSession) -> DataFrame:
    """``table_id, codon, aa, is_stop, is_start`` for all codes."""
    rows = [(t, c, g.amino[c], g.amino[c] == "*", c in g.all_starts) for t, g in ((t, genetic_code(t)) for t in CODES) for c in CODONS]
    return spark.createDataFrame(rows, "table_id int, codon string, aa string, is_stop boolean, is_start boolean")


def stop_frame(spark: SparkSession) -> DataFrame:
    """``table_id, codon, name``: every IUPAC codon that is a stop, by code."""
    rows = [(t, c, n) for t in CODES for c, n in resolved_stops(stop_set(t)).items()]
    return spark.createDataFrame(rows, "table_id int, codon string, name string")


def supported(table_id: Column) -> Column:
    """The id itself, or the default for an id that isn't known."""
    return F.when(table_id.isin(*CODES), table_id).otherwise(F.lit(DEFAULT))


def by_code(table_id: Column, value) -> Column:
    """An array of strings by code, ``value(id)`` for each."""
    out = F.array(*map(F.lit, value(DEFAULT)))
    groups: dict[tuple, list[int]] = {}
    for t in CODES:
        groups.setdefault(tuple(value(t)), []).append(t)
    for own, ids in groups.items():
        if own != tuple(value(DEFAULT)):
            out = F.when(table_id.isin(*ids), F.array(*map(F.lit, own)).cast("array<string>")).otherwise(out)
    return out


def stops_of(table_id: Column) -> Column:
    """The codons that stop translation under a code, IUPAC ones with them."""
    return by_code(table_id, lambda t: sorted(resolved_stops(stop_set(t))))


def amino_letters(table_id: Column) -> Column:
    """The 64 amino acids of a code, in the order of ``CODONS``."""
    letters = lambda t: "".join(genetic_code(t).amino[c] for c in CODONS)
    groups: dict[str, list[int]] = {}
    for t in CODES:
        groups.setdefault(letters(t), []).append(t)
    out = F.lit(letters(DEFAULT))
    for own, ids in groups.items():
        out = F.when(table_id.isin(*ids), F.lit(own)).otherwise(out)
    return out


def amino_acid(codon: Column, table_id: Column, letters: Column | None = None) -> Column:
    """One-letter amino acid of a codon; X for anything that isn't one.  ``letters`` saves working out the code's."""
    place = F.when(F.length(codon) == 3, F.instr(F.lit(",".join(CODONS)), F.upper(codon))).otherwise(0)
    return F.substring(F.concat(F.lit("X"), amino_letters(table_id) if letters is None else letters), F.floor((place + 3) / 4).cast("int") + 1, F.lit(1))


def amino_acid_at(data: Column, start: Column, letters: Column) -> Column:
    """The amino acid of the three bytes from ``start`` (from 1) of upper-case ``data``; ``letters`` are X and a code's."""
    place = F.instr(F.lit(",".join(CODONS)), F.substring(data, start, F.lit(3)).cast("string"))
    return F.substring(letters, F.shiftright(place + 3, 2) + 1, F.lit(1))


# Keywords that tell the code, tried in this order.
MITOCHONDRIAL = "mitochond"
INVERTEBRATE = r"invertebrate|insect|arthropod|drosophila|mosquito|\bfly\b|beetle|mollusc|mollusk|nematode|\bworm\b|annelid|crustacean|arachnid|\bbee\b|\bant\b|\bbutterfly\b|\bmoth"
MYCOPLASMA = "mycoplasma|spiroplasma|ureaplasma|mesoplasma|entomoplasma|mollicut"
BACTERIAL = r"chloroplast|plastid|cyanobacter|\bbacteri|archae|\bphage\b|endosymbiont|candidatus|escherichia|\be\.?\s*coli\b|\bcoli\b|salmonella|bacillus|pseudomonas|streptococc|staphylococc|klebsiella|mycobacter|\bvibrio\b|clostridi"
CILIATE = r"tetrahymena|paramecium|oxytricha|stylonychia|\bciliate"
NUCLEAR = r"homo sapiens|\bhuman\b|mus musculus|\bmouse\b|rattus|\brat\b|saccharomyces|cerevisiae|\byeast\b|arabidopsis|drosophila|caenorhabditis|elegans|danio|zebrafish|xenopus|gallus|\bsapiens\b"


#: In the order of the columns that ``keyword_marks`` makes.
KEYWORDS = {"mitochondrial": MITOCHONDRIAL, "invertebrate": INVERTEBRATE, "mycoplasma": MYCOPLASMA, "ciliate": CILIATE, "bacterial": BACTERIAL, "nuclear": NUCLEAR}


def keyword_marks(text: Column) -> dict[str, Column]:
    """Whether each group of keywords occurs."""
    low = F.lower(text)
    return {name: low.rlike(pattern) for name, pattern in KEYWORDS.items()}


def code_by_marks(found: dict[str, Column]) -> Column:
    """The code that keywords imply, by the rules in turn; null if none."""
    return (
        F.when(found["mitochondrial"], F.when(found["invertebrate"], 5).otherwise(2))
        .when(found["mycoplasma"], 4)
        .when(found["ciliate"] & ~found["bacterial"], 6)
        .when(found["bacterial"], 11)
        .when(found["nuclear"], 1)
    )


def organism_table(text: Column) -> Column:
    """The code that an organism's name or a header implies; null if none."""
    return code_by_marks(keyword_marks(text))


def organism_of_lines(lines: DataFrame) -> DataFrame:
    """One row: which groups of keywords occur in any of the lines (column ``line``), and the code that they imply together."""
    marks = [F.coalesce(F.max(mark), F.lit(False)).alias(name) for name, mark in keyword_marks(F.col("line")).items()]
    return lines.agg(*marks).withColumn("table_id", code_by_marks({name: F.col(name) for name in KEYWORDS}))
