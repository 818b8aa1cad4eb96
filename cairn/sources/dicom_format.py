"""Part-10 files of the public medical-imaging standard: data elements to and from Python values. No Spark in here."""

from __future__ import annotations

import struct
import zlib

#: Group, element, value representation and keyword of the elements that the engine names (fixed values).
_ELEMENTS = """
0002 0001 OB FileMetaInformationVersion
0002 0002 UI MediaStorageSOPClassUID
0002 0003 UI MediaStorageSOPInstanceUID
0002 0010 UI TransferSyntaxUID
0002 0012 UI ImplementationClassUID
0008 0005 CS SpecificCharacterSet
0008 0008 CS ImageType
0008 0016 UI SOPClassUID
0008 0018 UI SOPInstanceUID
0008 0020 DA StudyDate
0008 0021 DA SeriesDate
0008 0023 DA ContentDate
0008 0030 TM StudyTime
0008 0031 TM SeriesTime
0008 0033 TM ContentTime
0008 0050 SH AccessionNumber
0008 0060 CS Modality
0008 0064 CS ConversionType
0008 0070 LO Manufacturer
0008 0090 PN ReferringPhysicianName
0008 0100 SH CodeValue
0008 0102 SH CodingSchemeDesignator
0008 0104 LO CodeMeaning
0008 1030 LO StudyDescription
0008 103E LO SeriesDescription
0008 1090 LO ManufacturerModelName
0008 1115 SQ ReferencedSeriesSequence
0008 1140 SQ ReferencedImageSequence
0008 1150 UI ReferencedSOPClassUID
0008 1155 UI ReferencedSOPInstanceUID
0008 2112 SQ SourceImageSequence
0010 0010 PN PatientName
0010 0020 LO PatientID
0010 0030 DA PatientBirthDate
0010 0040 CS PatientSex
0010 1010 AS PatientAge
0010 1020 DS PatientSize
0010 1030 DS PatientWeight
0018 0015 CS BodyPartExamined
0018 0050 DS SliceThickness
0018 0060 DS KVP
0018 1000 LO DeviceSerialNumber
0018 1020 LO SoftwareVersions
0018 1030 LO ProtocolName
0018 1164 DS ImagerPixelSpacing
0018 5100 CS PatientPosition
0020 000D UI StudyInstanceUID
0020 000E UI SeriesInstanceUID
0020 0010 SH StudyID
0020 0011 IS SeriesNumber
0020 0012 IS AcquisitionNumber
0020 0013 IS InstanceNumber
0020 0032 DS ImagePositionPatient
0020 0037 DS ImageOrientationPatient
0020 0052 UI FrameOfReferenceUID
0020 0060 CS Laterality
0020 9111 SQ FrameContentSequence
0020 9113 SQ PlanePositionSequence
0020 9157 UL DimensionIndexValues
0028 0002 US SamplesPerPixel
0028 0004 CS PhotometricInterpretation
0028 0006 US PlanarConfiguration
0028 0008 IS NumberOfFrames
0028 0010 US Rows
0028 0011 US Columns
0028 0030 DS PixelSpacing
0028 0100 US BitsAllocated
0028 0101 US BitsStored
0028 0102 US HighBit
0028 0103 US PixelRepresentation
0028 0301 CS BurnedInAnnotation
0028 1050 DS WindowCenter
0028 1051 DS WindowWidth
0028 1052 DS RescaleIntercept
0028 1053 DS RescaleSlope
0028 2110 CS LossyImageCompression
0028 3110 SQ SoftcopyVOILUTSequence
0040 A040 CS ValueType
0040 A043 SQ ConceptNameCodeSequence
0040 A050 CS ContinuityOfContent
0040 A010 CS RelationshipType
0040 A160 UT TextValue
0040 A491 CS CompletionFlag
0040 A493 CS VerificationFlag
0040 A730 SQ ContentSequence
0042 0010 ST DocumentTitle
0042 0011 OB EncapsulatedDocument
0042 0012 LO MIMETypeOfEncapsulatedDocument
0062 0001 CS SegmentationType
0062 0002 SQ SegmentSequence
0062 0003 SQ SegmentedPropertyCategoryCodeSequence
0062 0004 US SegmentNumber
0062 0005 LO SegmentLabel
0062 0008 CS SegmentAlgorithmType
0062 0009 LO SegmentAlgorithmName
0062 000A SQ SegmentIdentificationSequence
0062 000B US ReferencedSegmentNumber
0062 000F SQ SegmentedPropertyTypeCodeSequence
0062 0020 UT TrackingID
0062 0021 UI TrackingUID
0070 0001 SQ GraphicAnnotationSequence
0070 0002 CS GraphicLayer
0070 0003 CS BoundingBoxAnnotationUnits
0070 0005 CS GraphicAnnotationUnits
0070 0006 ST UnformattedTextValue
0070 0008 SQ TextObjectSequence
0070 0009 SQ GraphicObjectSequence
0070 0010 FL BoundingBoxTopLeftHandCorner
0070 0011 FL BoundingBoxBottomRightHandCorner
0070 0012 CS BoundingBoxTextHorizontalJustification
0070 0020 US GraphicDimensions
0070 0021 US NumberOfGraphicPoints
0070 0022 FL GraphicData
0070 0023 CS GraphicType
0070 0024 CS GraphicFilled
0070 0060 SQ GraphicLayerSequence
0070 0062 IS GraphicLayerOrder
0070 0068 LO GraphicLayerDescription
0070 0080 CS ContentLabel
0070 0082 DA PresentationCreationDate
0070 0083 TM PresentationCreationTime
2050 0020 CS PresentationLUTShape
5200 9230 SQ PerFrameFunctionalGroupsSequence
7FE0 0010 OW PixelData
"""
NAMED = {int(g + e, 16): (vr, word) for g, e, vr, word in map(str.split, _ELEMENTS.strip().splitlines())}
TAG_OF = {word: (tag, vr) for tag, (vr, word) in NAMED.items()}
_WORDS = {tag: word for tag, (_, word) in NAMED.items()}

#: Representations of numbers as text or as bytes.
NUMERIC = frozenset("DS IS US SS UL SL FL FD UV SV".split())

#: Transfer syntaxes (fixed values): all others hold compressed pixels in explicit little-endian elements.
IMPLICIT, EXPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
PLAIN = (IMPLICIT, EXPLICIT, BIG, DEFLATED)

#: Character sets by their defined terms (fixed values); the plain set, and any term that isn't here, is read as UTF-8.
CHARSETS = {
    "ISO_IR 100": "latin_1", "ISO_IR 101": "iso8859_2", "ISO_IR 109": "iso8859_3", "ISO_IR 110": "iso8859_4", "ISO_IR 144": "iso8859_5", "ISO_IR 127": "iso8859_6", "ISO_IR 126": "iso8859_7", "ISO_IR 138": "iso8859_8",
    "ISO_IR 148": "iso8859_9", "ISO_IR 203": "iso8859_15", "ISO_IR 166": "tis_620", "ISO_IR 13": "shift_jis", "ISO_IR 192": "utf_8", "GB18030": "gb18030", "GBK": "gbk",
    "ISO 2022 IR 87": "iso2022_jp", "ISO 2022 IR 159": "iso2022_jp_2", "ISO 2022 IR 13": "shift_jis", "ISO 2022 IR 149": "euc_kr", "ISO 2022 IR 58": "gb2312",
}
_CHARSET_TAG = 0x00080005
#: Representations whose texts may be in another character set.
_WIDE = frozenset("LO LT PN SH ST UC UT".split())

#: Representations whose length has four bytes, and those that are numbers.
_LONG = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
_NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "UV": "Q", "SV": "q"}
_BYTES = {"OB", "OD", "OF", "OL", "OV", "OW", "UN"}
_OPEN = 0xFFFFFFFF
_ITEM, _ITEM_END, _SEQUENCE_END, _PIXELS = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0x7FE00010


class FormatError(ValueError):
    """Bytes that aren't a file of this format."""


#: The representations of short lengths by their bytes, and those that are texts of the plain set.
_SHORT = {vr.encode(): vr for vr in "AE AS AT CS DA DS DT FD FL IS LO LT PN SH SL SS ST TM UI UL US".split()}
_PLAIN = frozenset("AE AS CS DA DS DT IS TM UI".split())


def _charset(term: object) -> str:
    """The encoding of a defined term; of several, the first that names one (the others are reached by escapes within its texts)."""
    named = [CHARSETS[t] for t in (term if isinstance(term, list) else [term]) if t in CHARSETS]
    return named[0] if named else "utf_8"


class _Reader:
    def __init__(self, data: bytes, explicit: bool, big: bool):
        self.data, self.explicit, self.order, self.charset = data, explicit, ">" if big else "<", "utf_8"
        self.short = struct.Struct(f"{self.order}HH2sH").unpack_from

    def take(self, fmt: str, at: int) -> tuple:
        try:
            return struct.unpack_from(self.order + fmt, self.data, at)
        except struct.error:
            raise FormatError(f"cut off at byte {at}") from None

    def head(self, at: int) -> tuple[int, str, int, int]:
        """(tag, representation, length, where the value begins)."""
        try:
            group, element, name, n = self.short(self.data, at)
            if self.explicit and group != 0xFFFE and (vr := _SHORT.get(name)):
                return group << 16 | element, vr, n, at + 8
        except struct.error:  # cut off: told below
            pass
        group, element = self.take("HH", at)
        tag = group << 16 | element
        if group == 0xFFFE or not self.explicit:
            return tag, NAMED.get(tag, ("UN",))[0], self.take("I", at + 4)[0], at + 8
        vr = self.data[at + 4 : at + 6].decode("ascii", "replace")
        if vr in _LONG:
            return tag, vr, self.take("I", at + 8)[0], at + 12
        return tag, vr, self.take("H", at + 6)[0], at + 8

    def elements(self, at: int, end: int, closing: int | None = None, stop: int | None = None) -> tuple[dict, int]:
        """Values by tag up to the end, to the closing mark, or to the first tag from ``stop`` on; then the place is beyond the end."""
        out: dict[int, object] = {}
        while at < end:
            tag, vr, n, at = self.head(at)
            if tag == closing:
                return out, at
            if stop is not None and tag >= stop:
                return out, end + 1
            if vr == "SQ" or (n == _OPEN and tag != _PIXELS):
                out[tag], at = self.items(at, end if n == _OPEN else min(end, at + n), n == _OPEN)
            elif n == _OPEN:  # encapsulated pixels: fragments, no values of ours
                at, out[tag] = self.fragments(at), None
            else:
                if at + n > end:
                    raise FormatError(f"element {tag:08X} goes beyond the end")
                out[tag] = self.value(vr, self.data[at : at + n])
                at += n
                if tag == _CHARSET_TAG:
                    self.charset = _charset(out[tag])
        if closing is not None:
            raise FormatError("a sequence without its end")
        return out, at

    def items(self, at: int, end: int, open_: bool) -> tuple[list, int]:
        found = []
        while at < end:
            tag, _, n, at = self.head(at)
            if tag == _SEQUENCE_END:
                return found, at
            if tag != _ITEM:
                raise FormatError(f"{tag:08X} where an item was due")
            outer = self.charset  # an item may have a set of its own
            item, at = self.elements(at, end, _ITEM_END) if n == _OPEN else self.elements(at, min(end, at + n))
            self.charset = outer
            found.append(item)
        if open_:
            raise FormatError("a sequence without its end")
        return found, at

    def fragments(self, at: int) -> int:
        while True:
            tag, _, n, at = self.head(at)
            if tag == _SEQUENCE_END:
                return at
            at += n

    def value(self, vr: str, raw: bytes) -> object:
        if vr in _PLAIN:
            text = raw.decode("utf_8", "replace").strip("\0 ")
            return [x.strip() for x in text.split("\\")] if "\\" in text else text
        if vr in _BYTES:
            return raw
        if code := _NUMBERS.get(vr):
            size = struct.calcsize(code)
            got = list(struct.unpack(f"{self.order}{len(raw) // size}{code}", raw[: len(raw) // size * size]))
            return got[0] if len(got) == 1 else got or None
        text = raw.decode(self.charset if vr in _WIDE else "utf_8", "replace")
        text = text.rstrip("\0 ") if vr in ("UT", "ST", "LT") else text.strip("\0 ")
        if vr in ("UT", "ST", "LT") or "\\" not in text:
            return text
        return [x.strip() for x in text.split("\\")]


def decoded(data: bytes) -> tuple[dict[str, object], str]:
    """(values by keyword, or by the tag's hexadecimal text where the engine has no keyword; the transfer syntax)."""
    if data[128:132] != b"DICM":
        raise FormatError("no DICM mark after the preamble")
    reader, at, meta = _Reader(data, True, False), 132, {}
    while at + 2 <= len(data) and reader.take("H", at)[0] == 2:
        tag, vr, n, begin = reader.head(at)
        meta[tag], at = reader.value(vr, data[begin : begin + n]), begin + n
    syntax = str(meta.get(TAG_OF["TransferSyntaxUID"][0]) or IMPLICIT)
    body = zlib.decompress(data[at:], -15) if syntax == DEFLATED else data[at:]
    found, _ = _Reader(body, syntax != IMPLICIT, syntax == BIG).elements(0, len(body))
    return _named(found), syntax


def decoded_head(data: bytes) -> tuple[dict[str, object], str, bool]:
    """As ``decoded`` for the beginning of a file: what stands before the pixels, and whether they were reached.

    Raises FormatError where the bytes end within an element; more of the file may mend that."""
    if data[128:132] != b"DICM":
        raise FormatError("no DICM mark after the preamble")
    reader, at, meta = _Reader(data, True, False), 132, {}
    while at + 2 <= len(data) and reader.take("H", at)[0] == 2:
        tag, vr, n, begin = reader.head(at)
        if begin + n > len(data):
            raise FormatError("cut off in the first group")
        meta[tag], at = reader.value(vr, data[begin : begin + n]), begin + n
    syntax = str(meta.get(TAG_OF["TransferSyntaxUID"][0]) or IMPLICIT)
    body = zlib.decompressobj(-15).decompress(data[at:]) if syntax == DEFLATED else data[at:]
    found, end = _Reader(body, syntax != IMPLICIT, syntax == BIG).elements(0, len(body), stop=_PIXELS)
    return _named(found), syntax, end > len(body)


def _named(found: dict) -> dict[str, object]:
    plain = lambda v: [_named(x) for x in v] if isinstance(v, list) and v and isinstance(v[0], dict) else v
    return {_WORDS.get(t) or f"{t:08X}": plain(v) if type(v) is list else v for t, v in found.items()}


def _packed(vr: str, value: object) -> bytes:
    if vr == "SQ":
        return b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(x)) + x for x in (_elements(item) for item in value))
    if value is None:
        return b""
    if type(value) is str and vr not in _NUMBERS:
        raw = value.encode()
        return raw + (b"\0" if vr == "UI" else b" ") if len(raw) % 2 else raw
    if code := _NUMBERS.get(vr):
        values = value if isinstance(value, (list, tuple)) else [value]
        return struct.pack(f"<{len(values)}{code}", *values)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value) + b"\0" * (len(value) % 2)
    text = "\\".join(map(_number_text, value)) if isinstance(value, (list, tuple)) else _number_text(value)
    raw = text.encode()
    return raw + (b"\0" if vr == "UI" else b" ") * (len(raw) % 2)


def _number_text(x: object) -> str:
    """At most 16 characters for a number, as decimal strings must have."""
    return next(t for p in range(16, 0, -1) if len(t := f"{x:.{p}g}") <= 16) if isinstance(x, float) else str(x)


#: By keyword: the tag, the representation, an element's bytes before its length, and how that is written.
_HEADS = {word: (tag, vr, struct.pack("<HH2s", tag >> 16, tag & 0xFFFF, vr.encode()) + (b"\0\0" if vr in _LONG else b""), struct.Struct("<I" if vr in _LONG else "<H").pack) for word, (tag, vr) in TAG_OF.items()}


def _elements(values: dict[str, object]) -> bytes:
    out = []
    for (_, vr, head, length), value in sorted(((_HEADS[k], v) for k, v in values.items()), key=lambda x: x[0][0]):
        raw = _packed(vr, value)
        out += (head, length(len(raw)), raw)
    return b"".join(out)


#: This engine's own root: UIDs below 2.25 are made of UUIDs.
IMPLEMENTATION = "2.25.221746238651346281043874316927811040321"


def encoded(values: dict[str, object]) -> bytes:
    """An explicit little-endian file of values by keyword; it needs SOPClassUID and SOPInstanceUID."""
    meta = _elements(
        {
            "FileMetaInformationVersion": b"\0\1", "MediaStorageSOPClassUID": values["SOPClassUID"], "MediaStorageSOPInstanceUID": values["SOPInstanceUID"],
            "TransferSyntaxUID": EXPLICIT, "ImplementationClassUID": IMPLEMENTATION,
        }
    )
    return b"\0" * 128 + b"DICM" + struct.pack("<HH2sHI", 2, 0, b"UL", 4, len(meta)) + meta + _elements(values)
