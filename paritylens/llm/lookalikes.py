"""Characters that a reader can't tell apart."""

# Letters of other alphabets that look like a Latin letter, in
# code point order of the alphabets.
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Ϲ": "C", "Ϳ": "J",
}
CYRILLIC = {
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "Ү": "Y", "ү": "y", "Һ": "H", "һ": "h", "Ӏ": "I", "ӏ": "l",
    "ԁ": "d", "Ԍ": "G", "ԛ": "q", "Ԛ": "Q", "ԝ": "w", "Ԝ": "W",
}
ARMENIAN = {"Օ": "O", "օ": "o", "Տ": "S", "Լ": "L", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "ք": "p", "զ": "q"}
CHEROKEE = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G",
    "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
LATIN = {"ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ꓐ": "B", "ꓳ": "O"}
# Hyphens and marks drawn like the ASCII one.
MARKS = {"‐": "-", "‑": "-", "⁃": "-", "˗": "-", "−": "-"}
# End of the value list.

LOOKALIKES = {**GREEK, **CYRILLIC, **ARMENIAN, **CHEROKEE, **LATIN, **MARKS}

# Ranges of characters without ink or width beside category Cf.
NO_INK = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
