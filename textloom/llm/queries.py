"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from textloom.llm import p1_scans, p2_near, p3_pairs, p4_conversations, p5_pieces, p6_neighbours, p7_containers, p8_leaks, p9_residue

QUERIES = {
    "p1_found": p1_scans.p1_found,
    "p1_repaired": p1_scans.p1_repaired,
    "p2_found": p2_near.p2_found,
    "p2_groups": p2_near.p2_groups,
    "p3_found": p3_pairs.p3_found,
    "p4_found": p4_conversations.p4_found,
    "p4_conversations": p4_conversations.p4_conversations,
    "p4_merged": p4_conversations.p4_merged,
    "p5_found": p5_pieces.p5_found,
    "p5_pieces": p5_pieces.p5_pieces,
    "p6_found": p6_neighbours.p6_found,
    "p6_neighbours": p6_neighbours.p6_neighbours,
    "p7_found": p7_containers.p7_found,
    "p7_containers": p7_containers.p7_containers,
    "p8_found": p8_leaks.p8_found,
    "p8_leaks": p8_leaks.p8_leaks,
    "p9_found": p9_residue.p9_found,
    "p9_residue": p9_residue.p9_residue,
}
ORACLE = p2_near.ORACLE | p4_conversations.ORACLE | p5_pieces.ORACLE | p6_neighbours.ORACLE | p8_leaks.ORACLE
