"""Label aliases, anchors, markers, weights and constants. They decide results, so they stand as they are."""

# Folded label aliases by field.
ALIASES = {
    "Vkn": ("VERGI KIMLIK NUMARASI", "VERGI KIMLIK NO", "VERGI KIMLIK NUMARASI VKN", "VERGI NUMARASI", "VERGI NO", "VKN", "VERGI KIMLIK"),
    "Tckn": ("T C KIMLIK NUMARASI", "TC KIMLIK NUMARASI", "T C KIMLIK NO", "TC KIMLIK NO", "TURKIYE CUMHURIYETI KIMLIK NUMARASI", "TCKN", "T C K N"),
    "TicaretUnvani": ("TICARET UNVANI", "TICARET SICIL UNVANI", "TICARI UNVANI", "TICARET UNVANI ADI SOYADI", "UNVANI", "UNVAN"),
    "AdiSoyadi": ("ADI SOYADI", "ADI VE SOYADI", "AD SOYAD", "MUKELLEFIN ADI SOYADI"),
    "VergiDairesi": ("VERGI DAIRESI", "VERGI DAIRESI ADI", "VERGI DAIRESI MUDURLUGU", "BAGLI OLDUGU VERGI DAIRESI"),
    "IseBaslamaTarihi": ("ISE BASLAMA TARIHI", "ISE BASLAMA", "FAALIYETE BASLAMA TARIHI"),
    "AnaFaaliyetKodu": ("ANA FAALIYET KODU VE ADI", "ANA FAALIYET KODU", "FAALIYET KODU", "NACE KODU", "ANA FAALIYET KOD"),
    "AnaFaaliyetAciklamasi": ("ANA FAALIYET ACIKLAMASI", "ANA FAALIYET KONUSU", "FAALIYET KONUSU", "ANA FAALIYET", "FAALIYET ACIKLAMASI"),
    "Adres": ("IS YERI ADRESI", "ISYERI ADRESI", "MERKEZ ADRESI", "ADRESI", "ADRES"),
    "Boundary": ("VERGI TURU", "MUKELLEFIN", "TAKVIM", "BEYAN OLUNAN MATRAH", "TAHAKKUK EDEN VERGI", "ONAY KODU", "GELIR IDARESI BASKANLIGI", "HAZINE VE MALIYE BAKANLIGI", "VERGI LEVHASI"),
}
# Anchors of the document type and their weights.
ANCHORS = (
    ("VERGI LEVHASI", 0.45),
    ("VERGI KIMLIK NUMARASI", 0.25),
    ("HAZINE VE MALIYE BAKANLIGI", 0.20),
    ("GELIR IDARESI BASKANLIGI", 0.15),
    ("VERGI DAIRESI", 0.15),
    ("ISE BASLAMA TARIHI", 0.12),
    ("ANA FAALIYET KODU", 0.12),
    ("MALIYE BAKANLIGI", 0.10),
    ("TICARET UNVANI", 0.08),
)
# Words that mark an organisation, and endings that complete its name.
MARKERS = ("A S", "AS", "LTD", "STI", "SIRKETI", "ANONIM", "LIMITED", "SANAYI", "TICARET", "SAN", "TIC", "KOLLEKTIF", "KOMANDIT", "ORTAKLIGI", "HOLDING", "GRUP")
ENDINGS = ("AS", "A S", "LTD STI", "STI", "SIRKETI", "ORTAKLIGI", "HOLDING")
# Endings of an office's name, tried in this order.
OFFICE_ENDINGS = ("VERGI DAIRESI MUDURLUGU", "VERGI DAIRESI", "VD", "V D")
# Weights of the fields in the overall confidence.
WEIGHTS = {"vkn": 0.25, "tckn": 0.25, "ticaretUnvani": 0.15, "adiSoyadi": 0.15, "vergiDairesi": 0.15, "adres": 0.15, "iseBaslamaTarihi": 0.10, "anaFaaliyetKodu": 0.10, "anaFaaliyetAciklamasi": 0.05}
# Letters read in place of digits.
LOOKALIKES = {"0": "OoÖöDQ", "1": "Ilİı|!", "2": "Zz", "5": "SsŞş", "6": "Gb", "7": "T", "8": "B", "9": "gq"}
# What may stand between the digits of one number.
SEPARATORS = " \t.-/\\_:,' "
# How a value was found, and what its check says.
INLINE, SPATIAL, UNLABELLED = 0.98, 0.95, 0.55
CHECKED, UNCHECKED, NO_CHECK = 1.0, 0.5, 0.92
SUBSTITUTED = 0.75
# Similarity a label must reach, by the alias's length.
FUZZY = ((6, 1.00), (10, 0.90), (16, 0.86), (None, 0.82))
# First letters of accented ones that do not decompose as wanted.
FOLDED = dict(zip("çğıİiIöşüÇĞÖŞÜ", "CGIIIIOSUCGOSU", strict=True))
