"""Published vectors that queries and tests are held against. All are fixed values."""

# three code-blocks of a real encoder, LL orientation: name, width, height, passes, zero bit-planes, segment, coefficients
GOLDEN_BLOCKS = (
    (
        "gradient_8x8", 8, 8, 19, 2,
        "1308728597f637b5c8645a435b4b2abd4a4d18a4e85647764c294fee4f2cb7189af293c9d4f49ce610800000000000004580e3",
        (
            72, -112, -96, -80, -64, -48, -32, -16, -126, -123, -94, -78, -62, -46, -30, -14, -124, -108, -92, -76, -60, -44, -28, -12, -122, -106, -90, -74, -58, -42, -26, -10,
            -120, -104, -88, -72, -56, -40, -24, -8, -118, -102, -86, -70, -54, -38, -22, -6, -116, -100, -84, -68, -52, -36, -20, -4, -114, -98, -82, -66, -50, -34, -18, 127,
        ),
    ),
    (
        "sparse_8x8", 8, 8, 16, 3, "24091e9005e229ea96b6",
        (
            0, 0, 0, 0, 0, 0, 0, 0, 0, 22, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, -32, 0, 0, 0, 0, 32, 0, 0, 0, 0,
            0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 12, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, -28, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
        ),
    ),
    ("small_4x4", 4, 4, 10, 5, "15e089d64fd6d4c5", (2, -4, 0, 3, 0, -8, 8, 0, -3, 0, 0, -6, 0, 5, -1, 0)),
)

# the worked sequence of ITU-T T.88 H.2: coded bytes, and 256 decisions
H2_CODED = "84c73bfce1a1430402200000410dbb86f4317fff88ff37471adb6adfffac"
H2_DECODED = "00020051000000c0" "0352872aaaaaaaaa" "82c02000fcd79ef6" "bf7fed904f46a3bf"

# complete codestreams around the golden blocks: SHA-256
WRAPPED_SHA256 = {
    "gradient_8x8": "8a2c547a696ad8485c49f388d13d5d84c8d312d694cfb15caeb3dcda24b1a8fd",
    "sparse_8x8": "ec3078ff4087bf793d0128fd76f21341c03495c0a59e1d004eae2de91ed997ae",
    "small_4x4": "e0bd4b46f28c491b1e31f4f0338b93142f33ecb42c072fb4db543d0091b19eea",
}
_PACKET_HEADS = {"gradient_8x8": "cfb4cc", "sparse_8x8": "c7d414", "small_4x4": "c1f208"}


def wrapped(name: str) -> bytes:
    """A golden block as a one-block codestream: no wavelet level, 5/3, 8-bit unsigned."""
    _, w, h, _, _, segment, _ = next(b for b in GOLDEN_BLOCKS if b[0] == name)
    body = bytes.fromhex(_PACKET_HEADS[name] + segment)
    size = f"{w:08x}{h:08x}"
    head = "ff4fff5100290000" + size + "0" * 16 + size + "0" * 16 + "0001070101" + "ff52000c00000001000004040001" + "ff5c00044040"
    return bytes.fromhex(head + f"ff90000a0000{14 + len(body):08x}0001ff93") + body + bytes.fromhex("ffd9")
