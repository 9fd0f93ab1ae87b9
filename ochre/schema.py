"""The fixed schemas of the engine's tables."""

SEGMENTS = "array<struct<start:int,end:int,phase:int>>"
RECORDS = "seq_idx long, seq_id string, seq binary, length int, circular boolean, source_kind string"
FEATURES = (
    f"feat_idx long, seq_id string, type string, strand string, segments {SEGMENTS}, ordered_segments {SEGMENTS}, start int, end int, "
    "name string, locus_tag string, product string, protein_id string, transl_table int, phase int, "
    "transl_except array<struct<start:int,end:int,aa:string>>, id string, parent string, partial5 boolean, partial3 boolean, length_nt int"
)
HITS = "seq_idx long, seq_id string, start int, end int, strand string, frame int, codon string, name string, wraps boolean, rpos int"
FRAMES = ("+1", "+2", "+3", "-1", "-2", "-3")
CODING = ("CDS", "ORF")
#: Feature types that make a place non-coding rather than intergenic.
NONCODING = ("gene", "mRNA", "tRNA", "rRNA", "transcript", "ncRNA", "tmRNA")
CONTEXTS = ("cds-terminator", "orf-terminator", "cds-internal-inframe", "cds-recoded", "cds-internal-outframe", "within-noncoding-gene", "intergenic")
