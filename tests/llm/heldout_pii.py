"""Utterances written by hand, apart from the tables and their templates: each with the types that it contains."""

HELD_OUT = [
    ("You can reach me at jo@mail.example.org today", "email"),
    ("email me at jo.smith@mail.example.org", "email"),
    ("My new work address is k.lindqvist@northwharf.co.uk, the old one bounces.", "email"),
    ("forward everything to accounts+may@fjordline.no before Friday", "email"),
    ("It is tomas dot berg at fjordline dot no, all lower case.", "email"),
    ("Contact: press[at]northwharf[dot]com", "email"),
    ("billing (at) fjordline (dot) io is monitored by two people", "email"),
    ("I sent the photos to mum_and_dad77@homebase.net twice", "email"),
    ("Schreib an info@stadtwerke-beispiel.de wegen der Rechnung", "email"),
    ("Le dossier part à service.client@mutuelle-exemple.fr demain", "email"),
    ("Escríbeme a lucia.vega@correo-ejemplo.es", "email"),
    ("her login is j.doe @ campus . edu if you need it", "email"),
    ("CC: HEAD.OFFICE@NORTHWHARF.COM", "email"),
    ("the list runs on announce@lists.openforge.dev", "email"),
    ("Ring the garage on 020 7946 0958 and ask about the clutch", "phone"),
    ("call 555-867-5309 if the alarm goes off", "phone"),
    ("My number is (503) 555-0142, text first please", "phone"),
    ("She left +44 161 496 0018 on the answering machine", "phone"),
    ("+49 89 1234567 is the clinic's phone", "phone"),
    ("Appelle-moi au 06 12 34 56 78 ce soir", "phone"),
    ("Mi móvil es +34 612 345 678", "phone"),
    ("Ruf mich an: 0171 2345678", "phone"),
    ("the plumber's mobile: 0044 7700 900123", "phone"),
    ("telephone four one five, five five five, oh one two three after noon", "phone"),
    ("fax and phone are both 1-800-555-0199", "phone"),
    ("text me, 646.555.0111, when you land", "phone"),
    ("my social security number ends up as 219-09-9999 on the form", "national_id"),
    ("SSN 078-05-1120 was printed on a wallet insert", "national_id"),
    ("His passport number is C01X00T47 I think", "national_id"),
    ("National insurance number AB 12 34 56 C", "national_id"),
    ("Mein Personalausweis hat die Nummer L01X00T44", "national_id"),
    ("Mi DNI es 12345678Z", "national_id"),
    ("El NIE X1234567L caduca en mayo", "national_id"),
    ("Numéro de sécurité sociale : 2 85 05 78 006 084 36", "national_id"),
    ("tax ID 86 095 742 719 goes on page one", "national_id"),
    ("passport 533380006 was issued in Leeds", "national_id"),
    ("We live at 221 Harcourt Street now", "street_address"),
    ("Send the parcel to 14 Mill Lane, Ashby", "street_address"),
    ("Our office moved to 1600 Westlake Avenue last year", "street_address"),
    ("pick me up from 9 Rosemary Close", "street_address"),
    ("the flat is Flat 3, 27 Dunmore Terrace, Leith", "street_address"),
    ("Ich wohne in der Lindenstraße 12", "street_address"),
    ("Lieferadresse: Alter Markt Platz 7, 50667 Köln", "street_address"),
    ("Sie wohnt jetzt in der Goethestr. 8b", "street_address"),
    ("J'habite 12 rue de la République, Lyon", "street_address"),
    ("Le cabinet est au 4 bis, avenue Victor Hugo", "street_address"),
    ("Vivo en la calle Mayor 22, tercero", "street_address"),
    ("Entrega en Avenida de América, nº 37", "street_address"),
    ("Robert Kowalski bought a lamp.", "person_name"),
    ("We asked Zoe Fischer about it.", "person_name"),
    ("Thanks, Benjamin Okafor", "person_name"),
    ("My name is Amelie Laurent and I call about the lease", "person_name"),
    ("I finally met Dr. Whitcombe at the clinic", "person_name"),
    ("Mrs. Abernathy taught me piano", "person_name"),
    ("The form was signed by Oskar Lindgren", "person_name"),
    ("Fischer, Robert is first on the list", "person_name"),
    ("ask for Ingrid Solberg when you arrive", "person_name"),
    ("Herr Brandstetter hat den Schlüssel", "person_name"),
    ("Mein Name ist Henrik Vogel", "person_name"),
    ("Je suis passé chez Mme Delacroix", "person_name"),
    ("La señora Villanueva llamó ayer", "person_name"),
    ("then Charles Beaumont told us about the boat", "person_name"),
    ("I will be late, the bus broke down", ""),
    ("It cost 149.99 and shipping took 12 days", ""),
    ("See you at 18:30 at the corner", ""),
    ("My order number 4471-2298-03 never arrived", ""),
    ("ping me @ the station around noon", ""),
    ("I follow @gardenlady_22 for tips", ""),
    ("Robert said the meeting moved", ""),
    ("Zoe and Oskar went hiking", ""),
    ("flight LH1234 lands at 7", ""),
    ("The invoice 2024-00871 is overdue", ""),
    ("We walked along Harcourt Street for an hour", ""),
    ("it took 45 minutes on the road", ""),
    ("Version 10.4.2 fixed it", ""),
    ("ISBN 978-3-16-148410-0 is out of print", ""),
    ("The Okafor Foundation gave us a grant", ""),
    ("we stayed two nights at Fischer Lodge", ""),
    ("My doctor said it is fine", ""),
    ("coordinates 51.50735, -0.12776", ""),
]
