from helpers import lit, value
from ochre.functions import codes

STOPS = {1: "TAA TAG TGA", 2: "TAA TAG AGA AGG", 3: "TAA TAG", 4: "TAA TAG", 5: "TAA TAG", 6: "TGA", 9: "TAA TAG", 10: "TAA TAG", 11: "TAA TAG TGA", 12: "TAA TAG TGA", 13: "TAA TAG", 14: "TAG", 16: "TAA TGA", 21: "TAA TAG", 22: "TCA TAA TGA", 23: "TTA TAA TAG TGA", 24: "TAA TAG", 25: "TAA TAG", 26: "TAA TAG TGA", 27: "TGA", 28: "", 31: "", 33: "TAG"}


def test_definite_stops_of_all_codes():
    assert {t: " ".join(codes.genetic_code(t).stops) for t in codes.CODES} == STOPS


def test_unknown_code_is_the_default():
    assert codes.genetic_code(99).id == 11 and codes.genetic_code(None).id == 11


def test_ambiguous_codons():
    found = codes.resolved_stops(codes.stop_set(11))
    assert found["TAR"] == "stop" and found["TRA"] == "stop" and "TGN" not in found and found["TAA"] == "ochre"
    assert codes.ambiguous_stop_set(28) == {"TAA": "ambiguous", "TAG": "ambiguous", "TGA": "ambiguous"}


def test_translation(spark):
    assert codes.genetic_code(4).translate("tga") == "W"
    for codon, table, aa in (("ATG", 11, "M"), ("TGA", 4, "W"), ("TAA", 11, "*"), ("TAR", 11, "X"), ("AT", 11, "X"), ("aga", 2, "*"), ("GGG", 11, "G")):
        assert value(spark, codes.amino_acid(lit(codon), lit(table))) == aa, codon


def test_organisms(spark):
    cases = {"Homo sapiens": 1, "Homo sapiens mitochondrion": 2, "Drosophila mitochondrion": 5, "butterflyfish mitochondrion": 2, "Mycoplasma": 4, "Paramecium": 6, "Bacterial endosymbiont of Paramecium": 11, "Arabidopsis chloroplast": 11, "rock": None}
    for text, table in cases.items():
        assert value(spark, codes.organism_table(lit(text))) == table, text


def test_frames(spark):
    assert codes.codes_frame(spark).count() == 23
    assert codes.codon_frame(spark).where("is_stop").count() == sum(len(s.split()) for s in STOPS.values())
    assert codes.stop_frame(spark).where("table_id = 11").count() == 5
