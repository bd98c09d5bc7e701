"""The labelled table of the field: lines read and marked by hand, ``{kind|span}``; what is not marked is not personal.

Half of it are numbers that only look like personal data. Every fourth line is held out to measure the field.
"""

LINES = """\
Call me at {phone|030 1234567} after six
Tel. {phone|0171 2345678}, please leave a message
Phone: {phone|(555) 123-4567} ext. 12
my phone is {phone|555-867-5309} if you get lost
Tel {phone|0049 30 9018 2000}
Fax {phone|089 / 55 27 31} in the office
Mobile {phone|0160-9876543}
mob. {phone|07700 900123}
Telefon {phone|06221 54 0}, Zimmer 12
Telefonnummer {phone|0221/4710-123}
Rufnummer {phone|040 428 280}
Ruf mich an unter {phone|0176 55512345}
Handy {phone|0151 23456789}, abends
Fon: {phone|07031-98765}
Tél. {phone|01 42 68 53 00}
téléphone {phone|04.91.13.89.00}
appelez le {phone|06 12 34 56 78} avant midi
portable {phone|0612345678}
Teléfono {phone|91 344 32 00}
llame al {phone|600 123 456}
móvil {phone|655 443 322}
Ring {phone|020 7946 0018} for a table
dial {phone|1-800-555-0199} now
text {phone|(212) 555-0147}
phone {phone|415.555.2671}
call {phone|2125550123} today
WhatsApp {phone|0172 3334445}
contact: {phone|0800 1234567}
cell {phone|917-555-0133}
our fax is {phone|(0711) 216-0}
telephone {phone|01632 960 001}
Tel.:{phone|0341-9730}
phone {phone|00 44 20 7946 0958}
Hotline {phone|0180 5 123456}
card {card|4111.1111.1111.1111} expired
Visa {card|4111/1111/1111/1111}
Kreditkarte {card|5500.0000.0000.0004}
credit card {card|3400_000000_00009}
paid with {card|4012.8888.8888.1881}
MasterCard {card|5105/1051/0510/5100}
carte {card|4222_2222_2222_2220}
tarjeta {card|6011.1111.1111.1117}
amex {card|3782.822463.10005}
visa {card|4007.0000.0002.7000}
mail {email|anna@büro.example} for the key
write to {email|jürgen@localhost}
e-mail {email|müller@firma}
contact {email|root@intranet}
mail {email|josé@correo} mañana
send it to {email|admin@server1}
reach {phone|+1 (743) 555-3824} 45214521
{phone|+49 30 5550 1234} 20240517 late
at {phone|+44 20 7946 0958} 1234567
{phone|+33 1 42 68 53 00} 77881234
or {phone|+1 (212) 555-0147} 88123456 then
{phone|+1 (415) 555-2671} 12345678
the {phone|+1 (917) 555-0133} 5550199 of
{phone|+34 91 344 32 00} 5551234567
his {phone|+1 (650) 555-0191} 99887766
with {card|4111 1111 1111 1111} 20251231 it
{card|5500-0000-0000-0004} 1234567 on
the {card|4012 8888 8888 1881} 99887766
{card|6011 1111 1111 1117} 4521
{card|3782 822463 10005} 87654321
Order 4500012345 was shipped on Monday
+100 200 300 400 500 600 700 points
+1 000 000 000 000 000 000 of it
order 123 4567890 is late
invoice 2024-00017 over 1,299.00
Invoice no. 030 1234567 of last week
Rechnung 4711-0815 vom 3. Mai
Bestellung 900 123 456 ist da
ticket 555-123-4567 was closed
Ticket 0171 2345678
case 212 555 0147 is open
version 2.10.3 of 2021-05-04
v1.2.3.4.5 has a bug
release 10.15.7 (19H2) is out
chapter 12.4.1 and page 387
ISBN 978-3-16-148410-0
isbn 0-306-40615-2 in print
ISSN 2049-3630
part 415.555.2671 fits
model 0160-9876543
serial 4111.1111.1111.1112
Seriennummer 0151 23456789
tracking 00340434161094042557
parcel 1234567890123456 arrived
from 1990-1995 it was closed
born 1984-06-12 in Ulm
on 12.05.2024 at 14:30
at 9:15 and 17:45
between 10 000 and 12 500 people
1 234 567 visitors in 2019
population 3 644 826
about 600 123 456 euros
it costs 2.499,00 or 49.90 a month
price 1.299 now 999
score 21:19 21:17
52.5200 13.4050
lat 48.1371 lon 11.5754
10.12.2023 10:15:30
room 040 428 280
Raum 0221/4710
flight LH 1234 on 04.08
train ICE 578 at 06:51
Zip 10115 Berlin
PLZ 69120
postcode 75008 Paris
IBAN DE89 3704 0044 0532 0130 00
account 0532 0130 00
konto 7700 900123
row 17 seat 24
steps 1-800-555
ratio 16:9 at 1920x1080
100% of 250 ml
§ 14 Abs. 2 Nr. 3
3.14159265358979
6.02214076e23
0.000001 and 1e-9
192.168.1 is a prefix
300.400.500.600 is no address
1.2.3 and 4.5.6.7.8
@home and @work are signs
2 @ 5.00 each
meet @ 8
@ 20:00
#12 of 48
no. 7 and no. 11
Nr. 0176 55512345 im Katalog
article 06 12 34 56 78
item 91 344 32 00 in stock
código 655 443 322
pedido 600 123 456
commande 04.91.13.89.00
facture 0612345678
product 2125550123
sku 917-555-0133
batch 5500.0000.0000.0005
id 020 7946 0018
ref. 07700 900123
reference 089 55 27 31
line 01 42 68 53 00
code 1234 5678 9012 3456
key 4012.8888
size 42 43 44
lot 0800 1234567
form 1040 of 2023
bus 100 200 300
years 2001 2002 2003
call number 823.912 in the library
we call it 3.5
call 911
text 12 of the book
phone model 3310
Telefon von 1976
mail of 12.03.2020
card 7 of 52
""".splitlines()
