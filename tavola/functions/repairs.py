"""Fixed repair dictionaries for listing text.

Fixed values: these literal replacement pairs must equal the ones the
reference applies, in the same order, because replacement is sequential
and a later pair may see the output of an earlier one.
"""

REPAIRS_1: list[tuple[str, str]] = [
    ('Bras�_lia', 'Brasilia'),
    ('S��o Paulo', 'Sao Paulo'),
    ('��stanbul', 'Istanbul'),
    ('Caf��', 'Cafe'),
    ('G��vea', 'Gavea'),
    ('Rep�_blica', 'Republica'),
    ('Consola�_��o', 'Consolacao'),
    ('Pont��o', 'Pontao'),
    ('Jo��o', 'Joao'),
    ('Ant��nio', 'Antonio'),
    ('Bot��nico', 'Botanico'),
    ('Arauc��rias', 'Araucarias'),
    ('Guar��', 'Guara'),
    ('�guas', 'Aguas'),
    ('D�_ner', 'Doner'),
    ('B�_rek', 'Borek'),
    ('Pounds(��)', 'Pounds'),
]

REPAIRS_2: list[tuple[str, str]] = [
    ('Pizza �� Bessa', 'Pizza a Bessa'),
    ('Tayp��', 'Taypa'),
    ('Manzu��', 'Manzua'),
    ('Zaz�� Bistr�� Tropical', 'Zaza Bistro Tropical'),
    ('Fil�� de Ouro', 'File de Ouro'),
    ('Apraz�_vel', 'Aprazivel'),
    ('Terra�_o It��lia', 'Terraco Italia'),
    ('Divino Fog��o', 'Divino Fogao'),
    ('Esquina Mocot�_', 'Esquina Mocoto'),
    ('Cev�_che Tapas Bar & Restaurant', 'Ceviche Tapas Bar & Restaurant'),
    ("Longitude 77��03' Bar - Le Meridien Gurgaon", 'Longitude 7703 Bar - Le Meridien Gurgaon'),
    ('bu��no', 'buono'),
    ('M Cr��me', 'M Creme'),
    ('West��ross', 'Westcross'),
    ("Chawla's�_", 'Chawlas'),
    ('Con�_u', 'Concu'),
    ('Sahib��s Barbeque by Ohri��s', 'Sahibs Barbeque by Ohris'),
    ('NESCAF� Illusions', 'NESCAFE Illusions'),
    ('It��s Sinful', 'Its Sinful'),
    ('LaBont��', 'LaBonte'),
    ('Bon App��tit', 'Bon Appetit'),
    ('Delhite P��tisserie', 'Delhite Patisserie'),
    ('Die B�_ckerei', 'Die Backerei'),
    ('Rosart�� Chocolate', 'Rosarte Chocolate'),
    ('H�_agen-Dazs', 'Haagen-Dazs'),
    ('Saut��ed Stories', 'Sauteed Stories'),
    ('Vila S��nia', 'Vila Sonia'),
    ('Gazi Osman Pa��a', 'Gazi Osman Pasa'),
    ('Emirg��n', 'Emirgun'),
    ('Karak�_y', 'Karakoy'),
    ('Ko��uyolu', 'Kosuyolu'),
    ('Kuru�_e��me', 'Kurusesme'),
    ('Macunk�_y', 'Macunkoy'),
    ('��mitk�_y', 'Umitkoy'),
    ('Edif�_cio', 'Edificio'),
    ('L�_cio', 'Lucio'),
    ('Gon�_alves', 'Goncalves'),
    ('Pra�_a', 'Praca'),
    ('An�_bal', 'Anibal'),
    ('Am��ricas', 'Americas'),
    ('Cerqueira C��sar', 'Cerqueira Cesar'),
    ('Concei�_��o', 'Conceicao'),
    ('J�_nior', 'Junior'),
]

REPAIRS_TURKISH: list[tuple[str, str]] = [
    ('Kad۱k�_y', 'Kadikoy'),
    ('Be��ikta��', 'Besiktas'),
    ('�ankaya', 'Cankaya'),
    ('Kuru�_e��me', 'Kurusesme'),
    ('Karak�_y', 'Karakoy'),
    ('Emirg��n', 'Emirgan'),
    ('Macunk�_y', 'Macunkoy'),
    ('��mitk�_y', 'Umitkoy'),
    ('�ukurambar', 'Cukurambar'),
    ('�ayyolu', 'Cayyolu'),
]

# Currency name -> rate to Indian rupees (unmapped currencies give null).
CURRENCY_TO_INR: dict[str, float] = {
    'Indian Rupees(Rs.)': 1.0,
    'Dollar($)': 95.41,
    'Pounds': 127.75,
    'Emirati Diram(AED)': 26.07,
    'NewZealand($)': 55.63,
    'Rand(R)': 5.83,
    'Turkish Lira(TL)': 2.07,
    'Brazilian Real(R$)': 18.6,
    'Indonesian Rupiah(IDR)': 0.0053,
    'Qatari Rial(QR)': 26.19,
    'Sri Lankan Rupee(LKR)': 0.29,
    'Botswana Pula(P)': 7.04,
}
