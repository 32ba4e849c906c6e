"""Column functions on sequences. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabets, in the order of their states.
DNA = "ACGTRYMKWSBDHVN"
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"
# The standard and the vertebrate mitochondrial genetic code, codons in the order TCAG; * stops.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
MITO_CODE = "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG"
# The bases that each letter stands for, as bits A=1 C=2 G=4 T=8.
BASE_BITS = {"A": 1, "C": 2, "G": 4, "T": 8, "R": 5, "Y": 10, "M": 3, "K": 12, "W": 9, "S": 6, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}


def letters_only(c: Column) -> Column:
    """Upper-case A-Z; other characters, whatever their script, are dropped before the case is changed."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))


def dna_letters(c: Column) -> Column:
    """Drops what isn't one of the 15 nucleotide letters."""
    return F.regexp_replace(c, f"[^{DNA}]", "")


def protein_letters(c: Column) -> Column:
    """U becomes X; drops what is no residue."""
    return F.regexp_replace(F.translate(c, "U", "X"), f"[^{AMINO_ACIDS}X]", "")


def rna_to_dna(c: Column) -> Column:
    return F.translate(c, "U", "T")


def degap(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


def reverse_complement(c: Column) -> Column:
    """N, S, W, gaps and everything unknown stay, in reverse order."""
    return F.reverse(F.translate(c, "ACGTRYKMBVDH", "TGCAYRMKVBHD"))


def _codons(c: Column, per) -> Column:
    n = F.ceil(F.length(c) / 3).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: per(F.substring(c, i * 3 + 1, 3)))
    return F.when(n > 0, F.array_join(each, "")).when(n == 0, F.lit(""))


def translate_codons(c: Column, code: str = STANDARD_CODE) -> Column:
    """Residues of the codons from the first letter on. Stops, unknown codons and a codon cut short are X; --- is a gap."""
    # Bases as digits: a codon is then a number of three digits, which is its residue's place in a string.
    table = ["X"] * 334
    for k, residue in enumerate(code):
        table[100 * (k // 16) + 10 * (k // 4 % 4) + k % 4] = residue.replace("*", "X")
    residues = F.lit("".join(table))

    def spelled(digits: Column) -> Column:
        codons = F.regexp_extract_all(digits, F.lit("(?s)(...)"), F.lit(1))  # one pass, however long the sequence
        letter = lambda codon: F.coalesce(F.substring(residues, codon.try_cast("int") + 1, F.lit(1)), F.when(codon == "~~~", "-").otherwise("X"))
        each = F.array_join(F.transform(codons, letter), "")
        return F.when(F.length(digits) % 3 == 0, each).otherwise(F.concat(each, F.lit("X")))

    return _let(F.translate(c, "TCAG-+. ", "0123~~~~"), spelled)


def known_codons(c: Column, code: str = STANDARD_CODE) -> Column:
    """The letters with every codon that has no residue rewritten to NNN, as translation leaves them."""
    known = [a + b + d for (a, b, d), r in zip(((a, b, d) for a in "TCAG" for b in "TCAG" for d in "TCAG"), code, strict=True) if r != "*"] + ["---", "TAA", "TAG", "TGA"]
    return _codons(c, lambda codon: F.when(codon.isin(known), codon).otherwise("NNN"))


def degenerate_code(code: str = STANDARD_CODE) -> dict[str, str]:
    """Codons of ambiguous letters whose every reading has the same residue, generated from the code."""
    letters = {letter: [b for b, bit in (("A", 1), ("C", 2), ("G", 4), ("T", 8)) if bits & bit] for letter, bits in BASE_BITS.items()}
    plain = {a + b + d: r for (a, b, d), r in zip(((a, b, d) for a in "TCAG" for b in "TCAG" for d in "TCAG"), code, strict=True)}
    out = {}
    for x in DNA:
        for y in DNA:
            for z in DNA:
                read = {plain[a + b + d] for a in letters[x] for b in letters[y] for d in letters[z]}
                if len(read) == 1 and "*" not in read:
                    out[x + y + z] = read.pop()
    return out


def translate_degenerate(c: Column) -> Column:
    """As ``translate_codons``, but an ambiguous codon has a residue where all its readings agree."""
    table = F.create_map(*[F.lit(x) for kv in (degenerate_code() | {"---": "-"}).items() for x in kv])
    return _codons(c, lambda codon: F.coalesce(F.element_at(table, codon), F.lit("X")))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, which matters where a lambda uses it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def back_translate(protein: Column, dna: Column) -> Column:
    """The codons of a gapped protein row from its ungapped DNA: a gap takes ---, a residue the next three letters, or NNN."""

    def of_row(x: Column) -> Column:
        # Stretches of residues and of gaps alternate; a stretch's codons are one piece of the DNA.
        runs = F.regexp_extract_all(x["p"], F.lit("([^-]+|-+)"), 1)
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

        def add(s: Column, run: Column) -> Column:
            n = F.length(run)
            piece = F.substring(x["d"], s["at"], n * 3)
            whole = F.substring(piece, F.lit(1), F.length(piece) - F.length(piece) % 3)
            residues = F.concat(whole, F.repeat(F.lit("NNN"), (n - F.length(whole) / 3).cast("int")))
            gap = F.substring(run, F.lit(1), F.lit(1)) == "-"
            return F.struct(F.concat(s["out"], F.when(gap, F.repeat(F.lit("---"), n)).otherwise(residues)).alias("out"), F.when(gap, s["at"]).otherwise(s["at"] + n * 3).alias("at"))

        return F.aggregate(runs, start, add, lambda s: s["out"])

    return _let(F.struct(protein.alias("p"), dna.alias("d")), of_row)


def mock_back_translate(protein: Column) -> Column:
    """Each residue NNN, each gap ---."""
    return F.regexp_replace(F.regexp_replace(protein, "[^-]", "NNN"), "-", "---")


def mask_low_quality(seq: Column, quality: Column, least: int = 10) -> Column:
    """Letters whose phred value (ASCII less 33) is below ``least`` become n; of a record without quality none do."""
    masked = F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.when(F.ascii(F.substring(quality, i, 1)) - 33 < least, "n").otherwise(F.substring(seq, i, 1)))
    return F.when(quality.isNull() | (F.length(seq) == 0), seq).otherwise(F.array_join(masked, ""))


def branch_length(c: Column, least: float = 0.001, scale: float = 1.0, cap: float | None = 0.2) -> Column:
    """Lengths that are missing or not above 0 become ``least``; then scaled, then capped."""
    scaled = F.when(c > 0, c).otherwise(F.lit(least)) * F.lit(scale)
    return F.least(scaled, F.lit(cap)) if cap is not None else scaled


def base_bits(c: Column) -> Column:
    """The bases that a letter stands for, as bits; 0 for anything else."""
    table = F.create_map(*[F.lit(x) for kv in BASE_BITS.items() for x in kv])
    return F.coalesce(F.element_at(table, c), F.lit(0))


def bits_letter(c: Column) -> Column:
    """The letter of a set of bases; a gap for none."""
    table = F.create_map(*[F.lit(x) for k, v in BASE_BITS.items() for x in (v, k)])
    return F.coalesce(F.element_at(table, c), F.lit("-"))


def parsimony(a: Column, b: Column) -> Column:
    """Fitch: what two sets have in common, or else their union."""
    return F.when(a.bitwiseAND(b) > 0, a.bitwiseAND(b)).otherwise(a.bitwiseOR(b))


def child_parsimony(parent: Column, child: Column) -> Column:
    """What a child's set has in common with its parent's, or else its own."""
    return F.when(parent.bitwiseAND(child) > 0, parent.bitwiseAND(child)).otherwise(child)


def header_tag(comment: Column, tag: str) -> Column:
    """The value of the first blank-separated token that begins with ``tag=``; null without one."""
    tokens = F.filter(F.split(comment, "\\s+"), lambda t: t.startswith(f"{tag}="))
    return F.when(F.size(tokens) > 0, F.substring(F.element_at(tokens, 1), len(tag) + 2, 1 << 30))


def wrapped(c: Column, width: int) -> Column:
    """Lines of ``width`` characters."""
    return F.regexp_replace(c, f"(.{{{width}}})(?=.)", "$1\n")


def xml_escaped(c: Column) -> Column:
    """Text fit for an XML attribute."""
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c
