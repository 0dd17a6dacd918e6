"""Schemas of the engine's relations. Fragment ids are longs; a pair key is two columns, never a string."""

CONTIGS = "contig_id long, len long"
LIBRARIES = "lib string, lib_type string, insert_size long, sd double"
PAIRS = "lib string, c1 long, p1 long, m1 long, c2 long, p2 long, m2 long"
ALIGNMENTS = "qname long, tname long, qstrand int, tstrand int, score long, pct_sim double, tstart long, tend long, tlength long, qstart long, qend long, qlength long"
LINK_OBS = "lib string, lib_type string, c1 long, c2 long, cons int, diff double"
LAYOUT = "scaffold_id long, contig_id long, start double, end double, direct string, std double, len long"

#: Spread assumed for long-read libraries, whose files carry none (fixed value).
LONG_READ_SD = 100.0

#: How the line before a layout's fragments begins.
HEADLINE = "longest position"
