"""J1939 ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of parameter groups.
PGN_NAMES = {
    0xFEEC: "Vehicle Identification (VIN)", 0xF004: "Electronic Engine Controller 1 (EEC1)", 0xFEEF: "Engine Fluid Level/Pressure",
    0xFEE5: "Engine Hours/Revolutions", 0xFEF1: "Cruise Control/Vehicle Speed", 0xF000: "Torque/Speed Control",
    0xFECA: "Active Diagnostic Trouble Codes", 0xFECB: "Previously Active DTCs", 0xFEDA: "Software Identification",
    0xFEDB: "ECU Identification Information",
}


def pgn_name(pgn: Column) -> Column:
    unknown = F.concat(F.lit("PGN: 0x"), F.lower(F.lpad(F.hex(pgn), F.greatest(F.length(F.hex(pgn)), F.lit(4)), F.lit("0"))))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PGN_NAMES.items() for x in pair]), pgn.cast("int")), unknown)


def j1939_fields(can_id: Column) -> Column:
    """struct(priority, edp, dp, pf, ps, sa, pgn); PDU1 groups (PF below 240) drop the PS byte."""
    part = lambda shift, mask: F.shiftrightunsigned(can_id, shift).bitwiseAND(mask).cast("int")
    pf = part(16, 255)
    page = F.shiftrightunsigned(can_id, 8).bitwiseAND(0x3FFFF)
    pgn = F.when(pf >= 240, page).otherwise(page.bitwiseAND(0x3FF00))
    return F.struct(part(26, 7).alias("priority"), part(25, 1).alias("edp"), part(24, 1).alias("dp"), pf.alias("pf"), part(8, 255).alias("ps"), part(0, 255).alias("sa"), pgn.cast("long").alias("pgn"))
