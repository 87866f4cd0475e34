"""Row shapes and fixed values."""

from __future__ import annotations

WELL = ["plate", "well"]
CHANNELS = ["c1", "c2", "c3", "c4"]

TRACE = "plate string, well string, scan int, channel1 long, channel2 long, channel3 long, channel4 long, current long"
PEAKS = "well string, channel string, scan int, height double, width int, baseline double, area double, noise double"
BASE_CALLS = "plate string, well string, position int, base string, quality int, probability double"
PEAK_EDITS = "plate string, well string, op string, scan_idx int, channel string, seq long"
WINDOWS = "variant string, well string, position int, quality float, label int, x array<array<float>>"

# Formats, tables and constants that results depend on.
DETECTOR = {"height": 100, "prominence": 50, "distance": 5, "min_width": 1, "baseline": "None", "baseline_param": 500, "stutter": False, "stutter_window": 5, "scan_start": 0, "scan_end": 50000}
BASE_DETECT = {"height": 15, "prominence": 10, "distance": 5, "nms": 5}
MOBILITY_OFFSETS = (-3, -1, 1, 3)
CHANNEL_BASES = ("T", "G", "C", "A")
SMOOTH_WINDOW, SMOOTH_ORDER, WIDTH_HEIGHT, NOISE_SCANS, ALS_P, ALS_ROUNDS = 11, 2, 0.95, 200, 0.01, 10
CHEMISTRY_BASES = {
    "ET Terminators": "TGCA",
    "ET Primers": "ACTG",
    "TSII-v2": "AGCT",
    "SNuPe": "AGCT",
    "Cimarron": "TGCA",
}
CHEMISTRY_MOBILITY = {
    "ET Terminators": (-3, -1, 1, 3),
    "ET Primers": (0, 0, 0, 0),
    "TSII-v2": (-2, 0, 1, 3),
    "SNuPe": (-2, -1, 2, 3),
}
SPECTRAL_MATRIX = ((0.85, 0.03, 0.05, 0.07), (0.02, 0.88, 0.04, 0.06), (0.06, 0.04, 0.86, 0.04), (0.07, 0.05, 0.05, 0.83))
DISPLAY_MATRIX = ((0.90, 0.01, 0.04, 0.05), (0.01, 0.92, 0.02, 0.05), (0.05, 0.02, 0.90, 0.03), (0.04, 0.05, 0.04, 0.87))
MOBILITY_SEARCH = {0: (-5, -4, -3, -2, -1), 1: (-3, -2, -1, 0, 1), 2: (-1, 0, 1, 2, 3), 3: (1, 2, 3, 4, 5)}
STANDARD_POSITIONS = {
    "ABCC2": (2438, 2510, 2728, 2741),
    "CYBA": (2145, 2170, 2189, 2215),
    "GSTA1": (1841, 2754, 3038, 3330),
    "IL10": (1848, 2039, 2617, 2988),
    "rs1695": (1849, 2034, 2459, 2798),
}
BASE_LABELS = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}
GENOTYPES = {0: "fail", 1: "hom1", 2: "hom2", 4: "het"}
PLATE_RUN = {"scan_start": 2000, "scan_end": 2950, "n_standards": 4, "match_low": 5, "match_high": 25, "fwhm": 10}
DUPLEX_REGION, FEATURE_REGION = (1500, 1900), (1500, 2000)
RSD_CEILING = 200000
#: M13mp18, the public cloning vector's sequence from its cloning sites on.
M13_REFERENCE = (
    "TGCCAAGCTTGCATGCCTGCAGGTCGACTCTAGAGGATCCCCGGGTACCGAGCTCGAATTCGTAATCATGGTCATAGCTGTTTCCTGTGTGAAATTGTTA"
    "TCCGCTCACAATTCCACACAACATACGAGCCGGAAGCATAAAGTGTAAAGCCTGGGGTGCCTAATGAGTGAGCTAACTCACATTAATTGCGTTGCGCTCA"
    "CTGCCCGCTTTCCAGTCGGGAAACCTGTCGTGCCAGCTGCATTAATGAATCGGCCAACGCGCGGGGAGAGGCGGTTTGCGTATTGGGCGCCAGGGTGGTT"
    "TTTCTTTTCACCAGCGAGACGGGCAACAGCTGATTGCCCTTCACCGCCTGGCCCTGAGAGAGTTGCAGCAAGCGGTCCACGCTGGTTTGCCCCAGCAGGC"
    "GAAAATCCTGTTTGATGGTGGTTCCGAAATCGGCAAAATCCCTTATAAATCAAAAGAATAGCCCGAGATAGGGTTGAGTGTTGTTCCAGTTTGGAACAAG"
    "AGTCCACTATTAAAGAACGTGGACTCCAACGTCAAAGGGCGAAAAACCGTCTATCAGGGCGATGGCCCACTACGTGAACCATCACCCAAATCAAGTTTTT"
    "TGGGGTCGAGGTGCCGTAAAGCACTAAATCGGAACCCTAAAGGGAGCCCCCGATTTAGAGCTTGACGGGGAAAGCCGGCGAACGTGGCGAGAAAGGAAGG"
    "GAAGAAAGCGAAAGGAGCGGGCGCTAGGGCGCTGGCAAGTGTAGCGGTCACGCTGCGCGTAACCACCACACCCGCCGCGCTTAATGCGCCGCTACAGGGC"
    "GCGTACTATGGTTGCTTTGAC"
)
