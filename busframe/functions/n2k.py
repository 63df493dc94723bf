"""NMEA 2000 names and fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import settled
from .bits import extract_raw_le, signed, unsigned_double

# Parameter groups of one frame, and those sent as fast packets.
N2K_SINGLE = {
    126992: "System Date/Time", 126993: "Heartbeat", 127245: "Rudder", 127250: "Vessel Heading", 127251: "Rate of Turn",
    127252: "Heave", 127257: "Attitude", 127488: "Engine Parameters, Rapid Update", 127493: "Transmission Parameters, Dynamic",
    127501: "Binary Status Report", 127505: "Fluid Level", 127508: "Battery Status", 127750: "Charger Status (new)",
    128259: "Boat Speed", 128267: "Water Depth", 129025: "Position, Rapid Update", 129026: "COG & SOG, Rapid Update",
    129027: "Position Delta, Rapid Update", 129028: "Altitude Delta, Rapid Update", 129283: "Cross Track Error",
    130306: "Wind Data", 130310: "Environmental Parameters (Outside)", 130311: "Environmental Parameters", 130312: "Temperature",
    130313: "Humidity", 130314: "Actual Pressure", 130316: "Temperature, Extended Range", 130576: "Small Craft Status",
}
N2K_FAST = {
    126208: "Request/Command/Acknowledge Group Function", 126464: "PGN List (Transmit and Receive)", 126720: "Proprietary (fast packet)",
    126983: "Alert", 126984: "Alert Response", 126985: "Alert Text", 126986: "Alert Configuration", 126987: "Alert Threshold",
    126988: "Alert Value", 126996: "Product Information", 126998: "Configuration Information", 127233: "Man Overboard Notification",
    127237: "Heading/Track Control", 127489: "Engine Parameters, Dynamic", 127490: "Electric Drive Status (Dynamic)",
    127491: "Electric Energy Storage Status (Dynamic)", 127494: "Electric Drive Information", 127495: "Electric Energy Storage Information",
    127496: "Trip Fuel Consumption, Vessel", 127497: "Trip Fuel Consumption, Engine", 127498: "Engine Parameters, Static",
    127503: "AC Input Status", 127504: "AC Output Status", 127506: "DC Detailed Status", 127507: "Charger Status",
    127509: "Inverter Status", 127510: "Charger Configuration Status", 127511: "Inverter Configuration Status",
    127512: "AGS Configuration Status", 127513: "Battery Configuration Status", 127514: "AGS Status", 128275: "Distance Log",
    128520: "Tracked Target Data", 128538: "Elevator Car Status", 129029: "GNSS Position Data", 129038: "AIS Class A Position Report",
    129039: "AIS Class B Position Report", 129040: "AIS Class B Extended Position Report",
    129041: "AIS Aids to Navigation (AtoN) Report", 129044: "Datum", 129045: "User Datum Settings", 129284: "Navigation Info",
    129285: "Waypoint List", 129301: "Time to/from Mark", 129302: "Bearing and Distance between two Marks",
    129538: "GNSS Control Status", 129540: "GNSS Sats in View", 129541: "GPS Almanac Data",
    129542: "GNSS Pseudorange Noise Statistics", 129545: "GNSS RAIM Output", 129547: "GNSS Pseudorange Error Statistics",
    129549: "DGNSS Corrections", 129551: "GNSS Differential Correction Receiver Signal", 129556: "GLONASS Almanac Data",
    129792: "AIS DGNSS Broadcast Binary Message", 129793: "AIS UTC and Date Report", 129794: "AIS Class A Static Data",
    129795: "AIS Addressed Binary Message", 129796: "AIS Acknowledge", 129797: "AIS Binary Broadcast Message",
    129798: "AIS SAR Aircraft Position Report", 129799: "Radio Frequency/Mode/Power", 129800: "AIS UTC/Date Inquiry",
    129801: "AIS Addressed Safety Related Message", 129802: "AIS Safety Related Broadcast Message", 129803: "AIS Interrogation",
    129804: "AIS Assignment Mode Command", 129805: "AIS Data Link Management Message", 129806: "AIS Channel Management",
    129807: "AIS Group Assignment", 129808: "DSC Call Information", 129809: "AIS Class B Static Data, Part A",
    129810: "AIS Class B Static Data, Part B", 129811: "AIS Single Slot Binary Message", 129812: "AIS Multi Slot Binary Message",
    129813: "AIS Long-Range Broadcast Message", 129814: "AIS Single Slot Binary Message", 129815: "AIS Multi Slot Binary Message",
    129816: "AIS Acknowledge", 130052: "Loran-C TD Data", 130053: "Loran-C Range Data", 130054: "Loran-C Signal Data",
    130060: "Label", 130061: "Channel Source Configuration", 130064: "Route and WP Service - Database List",
    130065: "Route and WP Service - Route List", 130066: "Route and WP Service - Route/WP-List Attributes",
    130067: "Route and WP Service - Route - WP Name & Position", 130068: "Route and WP Service - Route - WP Name",
    130069: "Route and WP Service - XTE Limit & Navigation Method", 130070: "Route and WP Service - WP Comment",
    130071: "Route and WP Service - Route Comment", 130072: "Route and WP Service - Database Comment",
    130073: "Route and WP Service - Radius of Turn", 130074: "Route and WP Service - WP List - WP Name & Position",
    130320: "Tide Station Data", 130321: "Salinity Station Data", 130322: "Current Station Data", 130323: "Meteorological Station Data",
    130324: "Moored Buoy Station Data", 130330: "Lighting System Settings", 130561: "Lighting Zone", 130562: "Lighting Scene",
    130563: "Lighting Device", 130564: "Lighting Device Enumeration", 130565: "Lighting Color Sequence", 130566: "Lighting Program",
    130567: "Watermaker Input Setting and Status", 130568: "Entertainment Diagnostic Status",
    130569: "Entertainment Current File and Status", 130570: "Entertainment Library Data File",
    130571: "Entertainment Library Data Group", 130572: "Entertainment Library Data Search",
    130573: "Entertainment Supported Source Data", 130574: "Entertainment Supported Zone Data",
    130575: "Entertainment Parental Control Status", 130577: "Direction Data", 130578: "Vessel Speed Components",
    130580: "Entertainment System Configuration Status", 130581: "Entertainment Zone Configuration Status",
    130583: "Entertainment Available Audio EQ Presets", 130584: "Entertainment Bluetooth Devices",
    130586: "Entertainment Zone Configuration Status",
}

# Fields by group: name, bytes from, bytes, signed, scale, unit, decimals; scales in radians end in deg. An
# "id" field has no "not available" value.
DEG = "deg"
LAYOUTS: dict[int, tuple[int, list[tuple]]] = {
    126992: (8, [("sid", 0, 1, "id"), ("source", 1, 1, "low4"), ("days", 2, 2, "u", 1.0, "", 0), ("time", 4, 4, "u", 1e-4, " s", 1)]),
    127250: (8, [("sid", 0, 1, "id"), ("heading", 1, 2, "u", 1e-4, DEG, 2), ("deviation", 3, 2, "s", 1e-4, DEG, 2), ("variation", 5, 2, "s", 1e-4, DEG, 2), ("ref", 7, 1, "ref")]),
    127251: (5, [("sid", 0, 1, "id"), ("rate", 1, 4, "s", 3.125e-8, DEG, 3)]),
    127257: (7, [("sid", 0, 1, "id"), ("yaw", 1, 2, "s", 1e-4, DEG, 2), ("pitch", 3, 2, "s", 1e-4, DEG, 2), ("roll", 5, 2, "s", 1e-4, DEG, 2)]),
    129025: (8, [("lat", 0, 4, "s", 1e-7, "°", 7), ("lon", 4, 4, "s", 1e-7, "°", 7)]),
    129026: (6, [("sid", 0, 1, "id"), ("ref", 1, 1, "ref"), ("cog", 2, 2, "u", 1e-4, DEG, 2), ("sog", 4, 2, "u", 1e-2, " m/s", 2)]),
    129027: (8, [("sid", 0, 1, "id"), ("dt", 1, 1, "u", 5e-3, " s", 3), ("dlat", 2, 3, "s", 1 / 3600 * 1e-5, "°", 9), ("dlon", 5, 3, "s", 1 / 3600 * 1e-5, "°", 9)]),
    129028: (8, [("sid", 0, 1, "id"), ("dt", 1, 1, "u", 5e-3, " s", 3), ("quality", 2, 1, "low4"), ("ref", 2, 1, "ref4"), ("cog", 3, 2, "u", 1e-4, DEG, 2), ("dalt", 5, 3, "s", 1e-3, " m", 3)]),
    129029: (43, [
        ("sid", 0, 1, "id"), ("days", 1, 2, "u", 1.0, "", 0), ("time", 3, 4, "u", 1e-4, " s", 1), ("lat", 7, 8, "s", 1e-16, "°", 7),
        ("lon", 15, 8, "s", 1e-16, "°", 7), ("alt", 23, 8, "s", 1e-6, " m", 2), ("type", 31, 1, "low4"), ("method", 31, 1, "high4"),
        ("sats", 33, 1, "u", 1.0, "", 0), ("hdop", 34, 2, "s", 1e-2, "", 2), ("pdop", 36, 2, "s", 1e-2, "", 2),
    ]),
    129542: (15, [
        ("sid", 0, 1, "id"), ("rms", 1, 2, "u", 1e-2, " m", 2), ("std_major", 3, 2, "u", 1e-2, " m", 2), ("std_minor", 5, 2, "u", 1e-2, " m", 2),
        ("orientation", 7, 2, "u", 1e-4, DEG, 2), ("std_lat", 9, 2, "u", 1e-2, " m", 2), ("std_lon", 11, 2, "u", 1e-2, " m", 2), ("std_alt", 13, 2, "u", 1e-2, " m", 2),
    ]),
}
#: Texts of the descriptions, by group.
TEXTS = {
    126992: "SID {sid}  source {source}  days since 1970 {days}  time {time}",
    127250: "SID {sid}  heading {heading}  deviation {deviation}  variation {variation}  ref {ref}",
    127251: "SID {sid}  rate of turn {rate}/s",
    127257: "SID {sid}  yaw {yaw}  pitch {pitch}  roll {roll}",
    129025: "lat {lat}  lon {lon}",
    129026: "SID {sid}  ref {ref}  COG {cog}  SOG {sog}",
    129027: "SID {sid}  time delta {dt}  lat delta {dlat}  lon delta {dlon}",
    129028: "SID {sid}  time delta {dt}  GNSS quality {quality}  ref {ref}  COG {cog}  altitude delta {dalt}",
    129029: "SID {sid}  days {days}  time {time}  lat {lat}  lon {lon}  alt {alt}  type {type} method {method}  sats {sats}  HDOP {hdop}  PDOP {pdop}",
    129542: "SID {sid}  RMS {rms}  std major {std_major}  minor {std_minor}  orientation {orientation}  std lat {std_lat}  lon {std_lon}  alt {std_alt}",
}


def _raw(data: Column, start: int, size: int) -> Column:
    return extract_raw_le(data, start * 8, size * 8)


def _field(data: Column, start: int, size: int, *rest) -> Column:
    return _value(_raw(data, start, size), size, *rest)


def _value(raw: Column, size: int, kind: str, scale: float = 1.0, unit: str = "", _: int = 0) -> Column:
    if kind in ("u", "s"):
        missing = (1 << (8 * size - (kind == "s"))) - 1 if kind == "s" or size < 8 else -1
        number = signed(raw, 8 * size).cast("double") if kind == "s" else unsigned_double(raw) if size == 8 else raw.cast("double")
        number = number * scale
        return F.when(raw != missing, number * (180 / math.pi) if unit == DEG else number)
    if kind in ("ref", "ref4"):
        two = (raw if kind == "ref" else F.shiftright(raw, 4)).bitwiseAND(3)
        return F.when(two == 0, "True").when(two == 1, "Magnetic").when(two == 2, "Error").otherwise("n/a")
    return {"id": raw, "low4": raw.bitwiseAND(15), "high4": F.shiftright(raw, 4)}[kind]


def n2k_fields(pgn: int, data: Column) -> Column:
    """struct of the fields of one group; null where the payload is too short, null fields where not available."""
    least, layout = LAYOUTS[pgn]
    return F.when(F.size(data) >= least, F.struct(*[_field(data, *f[1:]).alias(f[0]) for f in layout]))


def with_n2k_fields(rows: DataFrame, pgn: int, data: str, name: str = "f") -> DataFrame:
    """Adds n2k_fields of a column of rows. The raw numbers are computed once, behind generators of one row, and the code
    of each step stays small enough to be compiled: that of the struct alone doesn't, for groups of many fields."""
    least, layout = LAYOUTS[pgn]
    kept = [f"`{c}`" for c in rows.columns]
    raws = settled(rows, *kept, **{f"_{f[0]}": _raw(F.col(data), *f[1:3]) for f in layout})
    fields = F.struct(*[_value(F.col(f"_{f[0]}"), *f[2:]).alias(f[0]) for f in layout])
    return settled(raws, *kept, **{name: F.when(F.size(data) >= least, fields)})


def n2k_description(pgn: Column, data: Column) -> Column:
    out = F.when(F.lit(False), "")
    for group, (least, layout) in LAYOUTS.items():
        shown = {}
        for name, *rest in layout:
            value = _field(data, *rest)
            if rest[2] in ("u", "s"):
                unit = "°" if rest[4] == DEG else rest[4]
                value = F.when(value.isNotNull(), F.concat(F.format_string(f"%.{rest[5]}f", value), F.lit(unit))).otherwise("n/a")
            shown[name] = value.cast("string")
        parts = []
        for piece in TEXTS[group].split("{"):
            name, brace, tail = piece.partition("}")
            parts += [shown[name], F.lit(tail)] if brace else [F.lit(piece)]
        out = out.when((pgn == group) & (F.size(data) >= least), F.concat(*parts))
    return out.otherwise("")
