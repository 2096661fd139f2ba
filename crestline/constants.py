"""Fixed values of the analysis."""

#: Seconds of a window; a window has floor(rate * this) frames.
WINDOW_SECONDS = 3.0040816326530613
#: Levels at or below are silence; the report format has a coarser limit of its own.
SILENT, REPORT_SILENT = 1e-12, 1e-6
#: Peaks from here on count as clipped.
CLIPPED = 0.99999
#: Histogram: values are level * BINS, cut to 0..BINS.
BINS = 10_000
#: Distances in dB to a rounding boundary that are a high and a medium risk.
HIGH_RISK, MEDIUM_RISK = 0.031, 0.051
#: Ratio of the two peaks above which the secondary is the better choice.
CLOSE_PEAKS = 0.8
MAX_CHANNELS = 32
BIT_DEPTHS = (8, 16, 24, 32, 64)
DSD_TIERS = (64, 128, 256, 512, 1024)
#: File extensions a scan takes.
EXTENSIONS = (
    "wav", "flac", "aiff", "alac", "m4a", "mp4", "mp3", "mp1", "aac", "ogg",
    "opus", "ac3", "ec3", "eac3", "dts", "dsf", "dff", "mkv", "webm",
)
#: Codecs whose packets depend on each other.
STATEFUL = ("mp3", "aac", "m4a", "ogg")
COMPRESSED = ("AAC", "MP3", "OGG Vorbis", "Opus", "FLAC", "ALAC")
#: Consecutive decode errors after which a file fails.
MAX_DECODE_ERRORS = 100
#: Layout name, channels, channel order, indices of low-frequency channels.
LAYOUTS = (
    ("5.1", "L R C LFE Ls Rs", (3,)),
    ("5.1_B", "L R Ls Rs C LFE", (5,)),
    ("5.1_C", "L C R Ls Rs LFE", (5,)),
    ("5.1_D", "C L R Ls Rs LFE", (5,)),
    ("6.1", "L R C LFE Ls Rs Cs", (3,)),
    ("7.1_A", "L R C LFE Ls Rs Lc Rc", (3,)),
    ("7.1_B", "C Lc Rc L R Ls Rs LFE", (7,)),
    ("7.1", "L R C LFE Ls Rs Rls Rrs", (3,)),
    ("EAC3_7.1_A", "L C R Ls Rs LFE Rls Rrs", (5,)),
    ("EAC3_7.1_B", "L C R Ls Rs LFE Lc Rc", (5,)),
    ("EAC3_7.1_E", "L C R Ls Rs LFE Vhl Vhr", (5,)),
    ("Atmos_5.1.2", "L R C LFE Ls Rs Ltm Rtm", (3,)),
    ("Atmos_5.1.4", "L R C LFE Ls Rs Vhl Vhr Ltr Rtr", (3,)),
    ("Atmos_7.1.2", "L R C LFE Ls Rs Rls Rrs Ltm Rtm", (3,)),
    ("Atmos_7.1.4", "L R C LFE Ls Rs Rls Rrs Vhl Vhr Ltr Rtr", (3,)),
    ("Atmos_9.1.6", "L R C LFE Ls Rs Rls Rrs Lw Rw Vhl Vhr Ltm Rtm Ltr Rtr", (3,)),
    ("DTS_7.1", "Lc C Rc L R Ls Rs LFE", (7,)),
    ("2.1", "L R LFE", (2,)),
    ("3.1", "L R C LFE", (3,)),
)
#: Names under which a layout is looked up (lower case): name, channels, layout.
LAYOUT_NAMES = (
    ("5.1", 6, "5.1"), ("5.1(side)", 6, "5.1"), ("itu_3_2_1", 6, "5.1"), ("mpeg_5_1_a", 6, "5.1"),
    ("7.1", 8, "7.1"), ("7.1(wide)", 8, "7.1"), ("itu_3_4_1", 8, "7.1"), ("mpeg_7_1_c", 8, "7.1"),
    ("6.1", 7, "6.1"), ("mpeg_6_1_a", 7, "6.1"),
    ("atmos_5.1.2", 8, "Atmos_5.1.2"), ("5.1.2", 8, "Atmos_5.1.2"),
    ("atmos_5.1.4", 10, "Atmos_5.1.4"), ("5.1.4", 10, "Atmos_5.1.4"),
    ("atmos_7.1.2", 10, "Atmos_7.1.2"), ("7.1.2", 10, "Atmos_7.1.2"),
    ("atmos_7.1.4", 12, "Atmos_7.1.4"), ("7.1.4", 12, "Atmos_7.1.4"),
    ("atmos_9.1.6", 16, "Atmos_9.1.6"), ("9.1.6", 16, "Atmos_9.1.6"),
    ("2.1", 3, "2.1"), ("3.1", 4, "3.1"),
)
#: Raw streams of this codec order their channels differently: name, channels (low-frequency index 5 in all).
RAW_EAC3 = (("5.1", 6), ("5.1(side)", 6), ("5.1.2", 8), ("7.1", 8), ("7.1(wide)", 8))
#: Display names of formats by channel count.
FORMAT_NAMES = {3: "2.1", 4: "3.1", 6: "5.1", 7: "6.1", 8: "7.1", 10: "7.1.2", 12: "7.1.4", 14: "7.1.6", 16: "9.1.6", 18: "9.1.8", 20: "9.1.10", 22: "11.1.10", 24: "11.1.12"}
#: Kind of error, its category in batch statistics, and the exit code.
ERRORS = (
    ("InvalidInput", "Other", 2),
    ("IoError", "Io", 1),
    ("FormatError", "Format", 2),
    ("DecodingError", "Decoding", 3),
    ("CalculationError", "Calculation", 4),
    ("OutOfMemory", "Calculation", 4),
    ("ResourceError", "Other", 5),
)
#: What a user can do about a kind of error.
HINTS = {
    "InvalidInput": "check the options and the input; --help lists what is accepted",
    "IoError": "check that the file exists and can be read",
    "FormatError": "use a file in a supported format",
    "DecodingError": "the file may be damaged, or its codec needs a registered decoder",
    "CalculationError": "check that the file holds valid samples",
    "OutOfMemory": "give the executors more memory or fewer cores each",
    "ResourceError": "check the resources of the machine or lower the parallelism, then retry",
}
#: Extensions of one-bit sources, the rate they are converted to and the gain in dB.
DSD_EXTENSIONS, DSD_RATE, DSD_GAIN_DB = ("dsf", "dff"), 352_800, 6.0
