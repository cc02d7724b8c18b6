"""A small labelled table: sentences with blanks, and public forms that fill the blanks.

A blank {kind} is labelled with its kind, {kind:variant} as well; other blanks, as {w} or {n}, are not labelled. Names and places
are common ones of their countries, numbers follow the forms that the countries publish, sentences are of everyday
letters, advertisements and forums. Every list is parted: each fifth entry is held out where a part is asked for.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

KINDS = ("email", "phone", "id_number", "address", "name")

# Sentences with personal information.
LINES = {
    "email": [
        "Please reply to {email} by Friday.", "You can reach our office at {email}.", "Invoices go to {email}", "Email: {email}", "e-mail {email}", "For refunds, {email} is the right address.", "I forwarded it to {email} yesterday", "contact us via {email}!", "{email} bounced twice today", "Her new address is {email}, the old one is dead.", "applications to {email}",
        "cc {email} on this", "Got a question? Drop me a line: {email}", "sign up with {email}", "{email} (office) or knock", "just mail {email}", "my address: {email}", "Send the keys to {email}, thanks", "feedback → {email}", "paypal is {email}",
        "Bitte antworten Sie an {email}.", "Rückfragen gern an {email}", "E-Mail: {email}", "Meine Adresse lautet {email}.", "Schickt das Formular an {email}", "Erreichbar über {email}, meist abends.", "Veuillez répondre à {email}.", "Pour toute question : {email}", "mon courriel est {email}", "Envoyez votre CV à {email}", "courriel : {email}", "{email} ne marche plus",
        "Puede responder a {email}.", "Mande la factura a {email}", "correo: {email}", "mi dirección es {email}, gracias", "Dudas en {email}", "{email} まで返信してください。", "問い合わせ先: {email}", "メール：{email}", "新しいアドレスは {email} です", "{email}",
    ],
    "phone": [
        "Call me back on {phone}.", "Phone: {phone}", "The clinic's line is {phone}, open till five.", "ring {phone} if nobody answers the door", "Tel: {phone}", "Tel. {phone}", "mobile {phone}", "text {phone} for the code", "You'll find us under {phone}", "fax: {phone}", "My new cell: {phone}", "If you see the dog, please call {phone}!", "dial {phone} and ask for the kitchen", "{phone} is my number", "lost your ticket? {phone}", "or WhatsApp me: {phone}", "Hotline {phone} (free)", "my phone is {phone} now", "reachable at {phone} until ten", "sms to {phone}",
        "Rufen Sie uns unter {phone} an.", "Telefon: {phone}", "Handynummer {phone}", "Ich bin unter {phone} zu erreichen.", "Mobil: {phone}", "Meldet euch bei {phone}", "Appelez-nous au {phone}.", "Tél. : {phone}", "mon portable est le {phone}", "joignable au {phone} après midi", "Téléphone {phone}", "Llámenos al {phone}.", "Teléfono: {phone}", "mi móvil es {phone}", "el número de la oficina es {phone}", "Tfno. {phone}", "電話番号は {phone} です。", "TEL {phone}", "携帯：{phone}", "お電話は {phone} へ", "{phone}",
    ],
    "id_number": [
        "My {id} was printed on the envelope.", "They wrote down {id} and kept a copy.", "Never post your {id} anywhere.", "the scan shows {id}", "{id} belongs to my late aunt", "for the tax office: {id}", "Please delete {id} from the thread", "I had to give {id} at the desk.", "it says {id} on the card", "The bank asked me for {id}.", "someone used {id} to open an account", "applicant, {id}, born in spring", "in the leak there is {id}", "why do you need {id}?", "{id}",
        "Meine {id} stand auf dem Brief.", "Das Amt wollte {id} haben.", "Im Antrag ist {id} angegeben.", "bitte {id} schwärzen", "Mon {id} figure sur la lettre.", "La mairie a noté {id}.", "on voit {id} sur la photo", "il faut fournir {id}", "Mi {id} aparece en la carta.", "En la oficina anotaron {id}.", "no compartas {id} con nadie", "el impreso lleva {id}", "書類に {id} と書いてあります。", "{id} を消してください。",
    ],
    "address": [
        "Send the parcel to {address}.", "Our new office: {address}", "I grew up at {address}, above the bakery.", "meet me at {address} around noon", "The flat is at {address}.", "Deliver to {address}, please.", "Address: {address}", "pickup only, {address}", "The concert moved to {address}!", "she lives at {address} with two cats", "Visit us: {address}", "the workshop is still in {address}", "taxi from {address} to the airport", "there was a fire at {address} last night", "{address}", "ship it to: {address}",
        "Unser Büro: {address:de}", "Das Paket geht an {address:de}.", "Wir wohnen seit Mai {address:de}.", "Treffpunkt ist {address:de} um acht.", "Anschrift: {address:de}", "Das Konzert findet {address:de} statt.", "{address:de}", "Nos bureaux : {address:fr}", "Le colis part au {address:fr}.", "Elle habite {address:fr} depuis mai.", "on se retrouve au {address:fr}", "Adresse : {address:fr}", "{address:fr}", "Nuestra oficina: {address:es}", "El paquete va a {address:es}.", "Vive en {address:es} desde mayo.", "quedamos en {address:es}", "Dirección: {address:es}", "{address:es}", "会場は {address:ja} です。", "住所：{address:ja}", "{address:ja} に引っ越しました。",
    ],
    "name": [
        "{name} will join us on Monday.", "Please ask {name} about the keys.", "Yours sincerely, {name}", "Regards, {name}", "Thanks, {name}!", "I spoke with {name} yesterday", "this was written by {name}", "Photo: {name}", "the author, {name}, was there too", "my neighbour {name} saw it", "Dear {name},", "a talk by {name}", "{name} and I went to school together", "Signed: {name}", "My name is {name}.", "report to {name}, second floor", "the lease is under {name}", "according to {name} it rained", "Booked for {name}", "it was {name} who called", "{name}", "as {name} said", "in memory of {name}", "my boss ({name}) agreed", "Teacher: {name}", "winner: {name}", "please pay {name} in cash", "credits: {name}", "best wishes from {name}", "I'm {name}, nice to meet you", "edited by {name} and {name}",
        "{name} kommt am Montag.", "Mit freundlichen Grüßen {name}", "Fragen Sie bitte {name}.", "ich bin {name} und neu hier", "Mein Name ist {name}.", "Foto: {name}", "das hat {name} geschrieben", "Liebe Grüße, {name}", "Danke an {name} für die Hilfe!", "{name} arrive lundi.", "Demandez à {name}.", "Je suis {name}, enchanté", "Mon nom est {name}.", "un texte de {name}", "Bien cordialement, {name}", "merci à {name} pour son aide", "{name} llega el lunes.", "Pregunte por {name}.", "Soy {name} y acabo de llegar", "Mi nombre es {name}.", "un texto de {name}", "Un saludo, {name}", "gracias a {name} por la ayuda",
        "担当は {name:ja} です。", "{name:ja} 様", "{name:ja} さんに聞いてください。", "写真：{name:ja}", "はじめまして、{name:ja} です。", "{name:ja} より",
    ],
}

# Sentences without, many of them close to it.
PLAIN = [
    "ok", "Thanks!", "so good!!", "🎉🎉🎉", "😂😂", "❤️", "🔥", "😍 wow", "✨ {w} ✨", "{n} {w}s, wow", "{n2} {w}s and more", "{n} {w}, not {n2}", "only {n2} {w}s left", "{n} Bilder, toll", "{n2} {W}, unglaublich", "{n} {w}, bravo", "a {w}-{w} {w}", "please re-{w} it", "pre-{w} or post-{w}?", "{w}-{w}!", "non-{w}", "{n} {W}, {W}", "{n2} {w}, genial", "+100", "lol", "👍👍", "Nice {w}.", "I love this {w} so much", "Where did you buy the {w}?", "the {w} is too {w} for my taste", "what a {w} {w}", "that {w} needs more {w}", "{W} and {W} go well together", "The {w} in the corner is lovely.", "more of the {w}, please", "can you do a {w} one next?", "Happy Birthday!", "Good Morning Everyone", "Merry Christmas to all", "see you next Monday", "in June or July maybe",
    "It cost {n} euros and {n2} cents.", "only $ {n2}.99 each", "€{n} for {n2} of them", "{n},{n2} EUR", "paid {n}.{n2} in total", "Posted on {n2}/{n2}/2023", "since 2019-0{d}-2{d}", "on 1{d}.0{d}.2022 it broke", "between 1998 and 2006", "at {n2}:{n2} sharp", "it takes {n2} hours and {n2} minutes", "version {d}.{n2}.{d} is out", "v{d}.{d} fails, v{d}.{n2}.{d} works", "update to {n2}.0.{d}-beta", "release {n2}.{n2} crashes", "a {n4}x{n4} image", "{n} x {n} cm", "{n4} × {n4} px", "ratio {d}:{d}", "{n} MB in {n2} files", "{n} likes and {n} comments", "1 of {n2}", "{n2}%", "page {n2} of {n}", "chapter {n2}, line {n}", "part {d} of {d}",
    "job {n5} finished", "job #{n4}-{n2} failed again", "run {n4}-{n4} is queued", "seed {n8} looks best", "seed: {n7}, steps: {n2}", "random seed {n10}", "post {n7} was removed", "see post #{n6}", "posts {n6} and {n6} are the same", "id={n6}", "item {n8} is sold out", "ticket {n6} closed", "order no. {n8} has shipped", "order {n4}-{n4}-{n4} arrived", "tracking {n10}{n2}", "part number {n4}-{n3}-{n2}", "article {n5}.{n3}", "ISBN 978-0-{n6}-{n2}-{d}", "serial {n4} {n4}", "error {n4} at line {n}", "0x{n4}ab{n2}", "checksum a{n4}f{n3}e{n2}", "md5 {n4}c0de{n4}", "commit {d}f{n4}a", "user {n5} joined", "build {n4}.{n3} is slow", "port {n4} is closed", "10.0.{n2}.{n2} does not answer", "192.168.{d}.{n2}:80{n2}", "row {n5}, column {n2}", "{n10} views", "{n8} results", "model {n4}-{n3}",
    "Thank you Anna", "thanks Paul!", "Maria is great", "Tom and Lucy are my favourites", "I want more Emma", "is that Oscar?", "Max looks tired in this one", "Danke, Julia", "Peter ist toll", "merci Sophie", "j'adore Louise", "gracias Elena", "me gusta Pablo", "Rosie & Jim", "Lily, Daisy and Violet bloom late", "April and May were cold", "Will it work? Mark it.", "Grace under pressure", "Hope this helps", "花子ちゃん可愛い", "太郎が好き",
    "@{w}{n2} please look", "thanks @{w}_{w}", "credit to @{w}.{w}", "follow @{w}{w} for more", "merci @{w}", "danke @{w}{n2}", "gracias a @{w}_{n2}", "u/{w}{w} said so", "@{W}{W}", "see {w}{w}.com/{w}", "https://{w}.example/{w}/{n4}", "www.{w}-{w}.org/{n4}", "mirror at {w}.example.com/{n6}", "{w}.{w}.net is offline", "{w}@2x.png", "{w}-{n2}@3x.jpg is blurry", "open {w}_{n2}.zip", "{w}.tar.gz is broken", "save as {W}{n2}.pdf", "look at the dot on the map", "at noon, at the {w}", "meet at the {w} dot", "the {w} at {w}",
    "Have you read The {W} {W}?", "{W} of the {W} is a good book", "the film {W} {W} was long", "I finished {W} and {W}", "“{W} {W}” is out on Friday", "my favourite band is The {W}s", "Captain {W} is the villain", "Lady {W} returns", "Lord {W} dies in part {d}", "Princess {W} and the {W}", "King {W} of {W}", "Sir {W} the Brave", "Doctor {W} is my favourite character", "Queen {W} again", "Agent {W} vs. Agent {W}", "the {W} Saga, volume {n2}", "episode {n2}: The {W}", "{W} {W} (2019) is underrated", "a {W} {W} fan art", "Team {W}", "Das {W} aus Band {n2}", "Der {W} {W} war gut", "Le {W} du chapitre {n2}", "El {W} del tomo {d}", "La reina {W} vuelve", "Prinz {W} ist zurück", "le capitaine {W} est mort",
    "Abbey Road is a good album", "Wall Street fell again", "the Baker Street mystery", "Sesame Street was better", "I like the {W} Street map", "{W} Road is my favourite track", "the {W} Avenue theme", "a song called {W} Lane", "the old {W} Square poster", "Park Avenue style", "Main Street looks empty in this picture", "the street at night, {n2} lamps", "turn left on the road", "{n2} streets, {n} houses", "Die Straße ist leer", "La rue est belle", "Rue {W}, un beau titre", "La calle del fondo", "die {W}straße in Folge {n2}", "{n2} roads lead there", "{n} square meters", "New York in winter", "Los Angeles at dawn", "San Francisco, then London", "the view from {W} Hill", "{W} Bridge in the fog", "Lake {W}", "St. {W} Church is closed",
    "My name is not important.", "call me later", "call it a day", "phone me when you can", "the number is wrong", "what is your number?", "ask at the desk", "the address is wrong", "I forgot my passport number", "my ID is missing", "send me a mail", "mail it tomorrow", "dear all,", "Sincerely yours", "Best regards", "signed and sealed", "Photo: private", "Credits: none", "by hand", "written by me", "Contact us any time", "Teacher: absent",
    "Wie schön!", "Das {w} ist zu groß.", "Wer hat das gemacht?", "Band {n2}, Seite {n}", "{n} Stück für {n2},50 Euro", "Auftrag {n5} fehlt", "Beitrag {n6} gelöscht", "Fassung {d}.{d} läuft nicht", "Um {n2} Uhr geht es los", "C'est magnifique !", "Le {w} est trop grand.", "tome {n2}, page {n}", "{n} pièces à {n2},50 euros", "commande {n6} perdue", "version {d}.{n2} en panne", "à {n2} h {n2}", "¡Qué bonito!", "El {w} es demasiado grande.", "tomo {n2}, página {n}", "{n} piezas a {n2},50 euros", "pedido {n6} perdido", "versión {d}.{n2} rota", "a las {n2}:{n2}", "とても綺麗です。", "{n2}章の{n}ページです。", "第{n2}巻を買いました。", "{n}円でした。", "版{d}.{n2}が動きません。", "次も楽しみにしています！", "注文{n6}が届きません。", "東京は雨です。", "大きな{w}ですね。", "2023年{d}月{n2}日から",
]

GIVEN = """Aaron Adam Adrian Agnes Alan Albert Alex Alexander Alfred Alice Amelia Amy Ana Andrea Andreas Andrew Angela Anja Ann Anna Anne Anthony Antoine Antonio Arthur Barbara Beatriz Ben Benjamin Bernard Birgit Brian Bruno
Camille Carla Carlos Carmen Caroline Catherine Charles Chloe Chris Christian Christine Claire Clara Claudia Daniel David Deborah Diana Diego Dieter Dominik Donald Dorothy Edgar Edward Elena Elisabeth Elizabeth Ella Emily Emma Eric Erik
Esther Eva Felix Fernando Florian Francis Francisco Frank Friedrich Gabriel George Georg Gerard Gloria Greta Guillermo Hannah Hans Harry Heinrich Helen Helga Henri Henry Hugo Ines Ingrid Irene Isabel Jack Jacob Jacques James Jan Jane
Javier Jean Jennifer Jessica Joan Johann John Jorge Joseph Juan Julia Julian Karen Karl Katharina Kevin Klaus Laura Leon Linda Lisa Louis Louise Lucas Lucia Lucy Luis Lukas Manuel Marc Margaret Maria Marie Mark Markus Martha Martin Mary
Matthew Max Michael Michel Miguel Monica Nancy Natalie Nicolas Nora Oliver Oscar Otto Pablo Patricia Paul Pedro Peter Philip Pierre Rachel Rafael Richard Robert Rosa Ruth Samuel Sandra Sarah Sebastian Simon Sofia Sophie Stefan Stephen
Susan Sven Teresa Thomas Tim Tom Ursula Valentin Veronica Victor Walter William Xavier Yvonne""".split()
# How family names are made: whole common ones, and common first and last parts.
FAMILIES = """Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Adams Baker Nelson Carter Mitchell Roberts Turner Phillips
Campbell Parker Evans Edwards Collins Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Bernard Dubois Durand Moreau Laurent Lefebvre Leroy Roux
Fournier Girard Bonnet Dupont Lambert Fontaine Rousseau García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Jiménez Ruiz Hernández Díaz Moreno Muñoz Álvarez Romero Rossi Ferrari Bianchi Novak Kowalski Nielsen Jensen
Hansen Larsson Olsen Silva Santos Costa Nowak Ivanov Petrov""".split()
BEGINS = "Black Red Fair Hol Wood Whit Brad Hart Haw Lang Dun Ched Bur Cal Chad Cran Dal El Far Fen Gar Had Har Hem Kel Kirk Lid Lin Mal Mar Mel Nor Oak Pem Pres Rad Rams Rad Shel Stan Sut Thorn Wal War Wes Win Wol Eich Rosen Birk Stein Berg Hirsch Lau Löw Sachs Wein Gold Silber Feld Bach Wald Blum Krau Reich Vogel Schön Beau Bel Cham Del Des Du Font Grand Mont Mar Per Vil Val Ar Az Bar Cas Cer Esp Her Iba Mor Oli Pal Que Sal Sar Tor Urr Zam".split()
ENDS = "ton ham ley ford wood worth field well son man brook by land stone more shaw mere gate dale cott burn bury hurst mann stein berg bach feld hofer inger el er hausen dorf wald thal ner eau ier ard et in ot ville mont court champs ault ez era ado osa illo eda ero arte iz ana ova enko ini elli".split()
KANJI_FAMILIES = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 斎藤 清水 山崎 森 池田 橋本 阿部 石川 前田 藤田 小川 岡田 後藤 長谷川 村上 近藤 石井 坂本 遠藤 青木 藤井 西村".split()
KANJI, KANJI_GIVEN = "田山川木村林森原野井上下中大小高石松竹梅藤沢島崎岡谷池橋本宮西東南北水月星雲霧鳥花坂", "太郎子美花一二三健翔大智恵由真優愛香里奈直樹介平司明和也幸彦春夏秋葉光"
KANA = "あいうえおかきくけこさしすせたちつとなにのはひふほまみむめもやゆよらりるれろわ"
PLACES = "London Leeds Bristol York Oxford Derby Boston Denver Austin Salem Dover Chester Dublin Cork Perth Albany Dayton Reno Tulsa Mobile Newtown Hillside Riverton Ashfield Weston Kingsbridge Lakewood Milford".split()
STREETS = "High Church Park Station Victoria Green Manor Kings Queens Grange Oak Cedar Maple Pine Elm Washington Lincoln Jefferson Franklin Highland Sunset Ridge Meadow Spring Chestnut Walnut Willow Court Market Bridge Castle Abbey Garden Forest".split()
KINDS_OF_STREET = "Street Road Avenue Lane Drive Close Way Court Place Square Boulevard Terrace Crescent St St. Rd Ave Ave. Dr. Blvd Ln".split()
PLACES_DE = "Berlin Hamburg München Köln Leipzig Dresden Bremen Essen Bonn Mainz Kassel Ulm Trier Jena Neustadt Rosenheim Oberhausen Waldkirch Altenburg Bad Homburg".split()
STREETS_DE = "Haupt Bahnhof Schul Garten Dorf Berg Kirch Wald Ring Linden Birken Mozart Schiller Goethe Markt Mühlen Park Wiesen Blumen Friedhof".split()
PLACES_FR = "Paris Lyon Lille Nantes Rennes Dijon Tours Reims Nice Brest Angers Metz Pau Saint-Denis Villeneuve Beauvais Montreuil Rochefort Clermont-Ferrand Chambéry".split()
STREETS_FR = ["de Rivoli", "de la Paix", "Victor Hugo", "des Lilas", "du Moulin", "de l'Église", "Jean Jaurès", "de la Gare", "Pasteur", "du Château", "des Écoles", "de la République", "Saint-Michel", "du Marché", "des Acacias"]
PLACES_ES = "Madrid Sevilla Valencia Bilbao Granada Toledo Burgos León Cádiz Murcia Vigo Gijón Cuenca Salamanca Villanueva Torrejón Alcalá Zaragoza Málaga Córdoba".split()
STREETS_ES = ["Mayor", "Alcalá", "de Atocha", "del Prado", "San Juan", "de la Iglesia", "Real", "Nueva", "de Cervantes", "del Sol", "de la Constitución", "Goya", "de los Olivos", "del Carmen", "Santa Ana"]
PLACES_JA = ["東京都千代田区", "東京都新宿区", "大阪府大阪市北区", "京都府京都市左京区", "愛知県名古屋市中区", "北海道札幌市中央区", "福岡県福岡市博多区", "神奈川県横浜市西区", "兵庫県神戸市", "宮城県仙台市青葉区"]
STREETS_JA = "丸の内 神田 梅田 栄 本町 中央 大通西 駅前 桜木町 南町 上野 青葉".split()
WORDS = "apple table window summer paper coffee garden mountain silver orange quick small bright heavy gentle blue winter mirror bottle candle bread butter carpet chair cloud corner desert dragon engine feather finger forest glass hammer island jacket kettle ladder market needle ocean pencil pepper pillow planet pocket puzzle rabbit ribbon saddle shadow spider spring storm sugar tiger tower tunnel velvet village violin wagon water whale wizard yellow".split()
HOSTS = "example.com example.org example.net mail.example.com gmail.com yahoo.com outlook.com web.de gmx.de free.fr orange.fr correo.es post.example.co.uk firma.example school.example.edu mail.test box.invalid my-shop.example.fr team.example.io proton.me".split()


class _Filler:
    """What fills the blanks, from one part of every list: `train`, `held` (each fifth entry) or `all`."""

    def __init__(self, r: random.Random, part: str, words: Sequence[str]):
        self.r, self.part, self.words = r, part, words
        self.own_words = self.of(words)

    def of(self, entries: Sequence[str]) -> Sequence[str]:
        if self.part == "all":
            return entries
        return [x for i, x in enumerate(entries) if (i % 5 == 0) == (self.part == "held")]

    def pick(self, entries: Sequence[str]) -> str:
        return self.r.choice(self.of(entries))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def form(self, *forms: str) -> str:
        """One of the forms, where 9 stands for any digit, 8 for one of 1-9 and ^ for any capital letter."""
        r = self.r
        return "".join(r.choice("0123456789") if c == "9" else r.choice("123456789") if c == "8" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "^" else c for c in r.choice(forms))

    def family(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.25:
            out = self.pick(FAMILIES)
        elif x < 0.6:
            out = self.pick(BEGINS) + self.pick(ENDS)
        elif x < 0.8:
            out = self.made().title() + self.pick(ENDS)
        else:
            out = (self.made() + self.made() + r.choice(["", "", "n", "s", "a", "o", "i"])).title()
        y = r.random()
        if y < 0.04:
            out = r.choice(["O'", "Mc", "Mac", "D'", "Fitz"]) + out
        elif y < 0.08:
            out += "-" + self.pick(BEGINS) + self.pick(ENDS)
        elif y < 0.12:
            out = r.choice(["de ", "van ", "von ", "de la ", "di ", "del ", "van der "]) + out
        return out

    def made(self) -> str:
        """A syllable."""
        r = self.r
        return r.choice("b br c ch cl d dr f fl g gr h j k kl l m n p pr qu r s sch sh sl st t th tr v w z".split()) + r.choice("a a e e i o o u ai ea ee ie ou au".split()) + r.choice(["", "", "", "ck", "d", "l", "ll", "m", "n", "nd", "ng", "nt", "r", "rd", "rs", "rt", "s", "st", "t", "x"])

    def given(self) -> str:
        r = self.r
        if r.random() < 0.8:
            return self.pick(GIVEN)
        return self.made().title() + r.choice(["a", "o", "ie", "an", "en", "in", "ina", "ella", "ius", "us", "ara", "ette", "ik"])

    def name(self, variant: str) -> str:
        r = self.r
        if variant == "ja":
            first = self.pick(KANJI_FAMILIES) if r.random() < 0.4 else "".join(r.sample(KANJI, r.choice([1, 2, 2, 3])))
            if r.random() < 0.1:
                first += r.choice("ヶノ々") + r.choice(KANJI)
            x = r.random()
            given = "".join(r.sample(KANJI_GIVEN, r.choice([1, 2, 2, 3]))) if x < 0.5 else "".join(r.sample(KANA, r.choice([2, 3]))) if x < 0.85 else "".join(r.sample(KANA, 2)) + r.choice(KANJI_GIVEN)
            return first + r.choice([" ", " ", " ", "　"]) + given
        g, f, m = self.given(), self.family(), r.choice("ABCDEFGHJKLMNPRSTVW")
        x = r.random()
        out = f"{g} {f}" if x < 0.55 else f"{f}, {g}" if x < 0.68 else f"{g[0]}. {f}" if x < 0.78 else f"{g} {m}. {f}" if x < 0.86 else f"{g[0]}. {m}. {f}" if x < 0.9 else f"{f}, {g[0]}." if x < 0.93 else f"{f} {g}" if x < 0.95 else f"{g[0]}.{m}. {f}" if x < 0.97 else f"{g} {self.given()} {f}"
        y = r.random()
        return out.upper() if y < 0.12 else out.lower() if y < 0.26 else out

    def phone(self, variant: str) -> str:
        return self.form(
            "899-999-9999", "899.999.9999", "899 999 9999", "(899) 999-9999", "(899) 999 9999", "+1 899 999 9999", "+1-899-999-9999", "+1 (899) 999-9999", "+18999999999", "1-800-999-9999", "899-9999", "+44 20 9999 9999", "+44 7999 999999", "+447999999999", "020 9999 9999", "07999 999999", "07999 999 999", "0161 999 9999", "(020) 9999 9999", "+353 8 999 9999",
            "030 99999999", "089/9999999", "0171 9999999", "0171/9999999", "(030) 99999-99", "+49 30 99999999", "+49 171 9999999", "+49 (0)89 99999-9", "+49 89 99999-999", "0049 30 9999999", "040 9999 9999", "0221-9999999", "089 99999 999", "+43 1 9999999", "+41 44 999 99 99", "044 999 99 99",
            "08 99 99 99 99", "08.99.99.99.99", "08-99-99-99-99", "0899999999", "+33 8 99 99 99 99", "+33899999999", "0033 8 99 99 99 99", "699 999 999", "699 99 99 99", "91 999 99 99", "+34 699 999 999", "+34 91 999 99 99", "+34699999999", "93-999-99-99", "+39 02 9999999", "+39 399 999 9999", "+31 6 99999999", "+32 2 999 99 99", "+351 999 999 999",
            "03-9999-9999", "06-9999-9999", "090-9999-9999", "080-9999-9999", "0899-99-9999", "+81 90-9999-9999", "+81-3-9999-9999", "+86 139 9999 9999", "+91 98999 99999", "+61 2 9999 9999", "+55 11 99999-9999", "+7 999 999-99-99", "+48 999 999 999", "+46 70 999 99 99",
        )

    def id_number(self) -> tuple[str, str]:
        """What a number is called before it, which isn't part of it, and the number."""
        forms = {
            "SSN": ("899-99-9999", "899 99 9999"), "social security number": ("899-99-9999", "899999999"), "social security no.": ("899-99-9999",), "ITIN": ("999-79-9999",), "tax ID": ("89-9999999",), "taxpayer number": ("89-9999999", "8999999999"), "NI number": ("^^ 99 99 99 ^", "^^999999^", "^^ 999999 ^"), "National Insurance number": ("^^ 99 99 99 ^", "^^999999^"), "NINO": ("^^999999^",), "national ID": ("8999-99999-9", "899999999", "^99999999"), "ID card": ("^99999999", "^^9999999", "899999999"), "identity card": ("^^999999", "^99999999"),
            "passport": ("^9999999", "^^9999999", "^99999999", "899999999", "99^^99999"), "passport no.": ("^9999999", "^^9999999", "899999999"), "passport number": ("^9999999", "^^9999999", "^99999999"), "Passport:": ("^9999999", "^^9999999"), "SIN": ("899 999 999",), "TFN": ("899 999 999",), "Aadhaar": ("8999 9999 9999",), "PAN": ("^^^^^9999^",), "CPF": ("899.999.999-99",), "PESEL": ("89999999999",),
            "Steuer-ID": ("89 999 999 999", "89999999999"), "Steueridentifikationsnummer": ("89 999 999 999",), "Steuernummer": ("89/999/99999",), "Personalausweis": ("^99999999", "^99^99^99", "^99999999"), "Personalausweisnummer": ("^99999999",), "Reisepass": ("^99999999", "^9999^999"), "Reisepassnummer": ("^99999999",), "Sozialversicherungsnummer": ("89 999999 ^ 999",), "numéro de sécu": ("8 99 99 99 999 999 99", "8 99 99 99 999 999", "899999999999999"), "n° de sécurité sociale": ("8 99 99 99 999 999 99", "8 99 99 99 999 999"), "numéro fiscal": ("8999999999999",), "passeport": ("99^^99999",), "carte d'identité": ("999999999999", "^9^9^9^9^"),
            "DNI": ("99999999^", "99999999-^", "99.999.999-^"), "NIE": ("X9999999^", "Y9999999^", "X-9999999-^"), "NIF": ("99999999^", "X9999999^"), "pasaporte": ("^^^999999", "^^999999"), "número de la seguridad social": ("89 9999999999",), "マイナンバー": ("8999 9999 9999", "899999999999"), "旅券番号": ("^^9999999",), "個人番号": ("8999 9999 9999",), "codice fiscale": ("^^^^^^89^89^999^",), "personnummer": ("899999-9999",),
        }
        bare = ("899-99-9999", "899-99-9999", "^^ 99 99 99 ^", "^^999999^", "99999999^", "X9999999^", "8 99 99 99 999 999 99", "^99999999", "899.999.999-99")
        lead = self.pick(list(forms))
        if self.r.random() < 0.25:
            return "", self.form(*bare)
        return lead + self.r.choice([" ", " ", " ", ": "] if lead[-1] != ":" else [" "]), self.form(*forms[lead])

    def address(self, variant: str) -> str:
        r = self.r
        n = str(r.choice([r.randint(1, 20), r.randint(1, 250), r.randint(1, 9999) if not variant else r.randint(1, 99)]))
        if variant == "de":
            kind = r.choice(["straße", "straße", "str.", "weg", "platz", "gasse", "allee", "ring", "strasse", "damm"])
            street = self.pick(STREETS_DE) + kind if r.random() < 0.6 else r.choice(["Am ", "An der ", "Im ", "Zum ", "Alter ", "Lange "]) + self.pick(STREETS_DE).title() + r.choice(["", "platz", "weg", "hof", "tor"]) if r.random() < 0.5 else self.family() + "-" + self.family() + r.choice(["-Straße", "-Str.", "-Weg", "-Platz"]) if r.random() < 0.3 else self.pick(PLACES_DE) + "er " + r.choice(["Straße", "Str.", "Weg", "Allee", "Platz"])
            p = self.pick(PLACES_DE) if r.random() < 0.6 else self.pick(BEGINS) + r.choice(["bach", "hausen", "dorf", "burg", "feld", "tal", "au", "heim"])
            return f"{street} {n}{r.choice(['', '', '', 'a', 'b', ' c'])}" + r.choice([f", {self.digits(5)} {p}", f", {self.digits(5)} {p}", f" in {p}", f", {p}", "", f"\n{self.digits(5)} {p}"])
        if variant == "fr":
            street = r.choice(["rue", "rue", "rue", "avenue", "boulevard", "place", "chemin", "impasse", "quai", "allée", "cours", "Rue", "av.", "bd"]) + " " + (self.pick(STREETS_FR) if r.random() < 0.7 else r.choice(["de ", "du ", "des ", ""]) + self.family())
            p = self.pick(PLACES_FR) if r.random() < 0.6 else self.pick(BEGINS) + r.choice(["ville", "court", "mont", "bois", "fontaine", "-sur-Mer", "-le-Bois"])
            return f"{n}{r.choice(['', '', '', ' bis', ' ter'])}{r.choice([', ', ' '])}{street}" + r.choice([f", {self.digits(5)} {p}", f" à {p}", f", {p}", "", f"\n{self.digits(5)} {p}"])
        if variant == "es":
            street = r.choice(["Calle", "Calle", "C/", "c/", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Ronda", "calle", "plaza"]) + " " + (self.pick(STREETS_ES) if r.random() < 0.7 else r.choice(["de ", "del ", "de la ", ""]) + self.family())
            p = self.pick(PLACES_ES) if r.random() < 0.6 else self.pick(BEGINS) + r.choice(["illa", "ares", "eda", "albo", "erta", " de la Sierra", " del Río"])
            flat = r.choice(["", "", f", {r.randint(1, 9)}º {r.choice('ABCD')}", f", {r.randint(1, 9)}º", f", piso {r.randint(1, 9)}"])
            return f"{street}{r.choice([' ', ', ', ' nº ', ', nº '])}{n}{flat}" + r.choice([f", {self.digits(5)} {p}", f", {p}", "", f" de {p}", f" en {p}"])
        if variant == "ja":
            place = self.pick(PLACES_JA) if r.random() < 0.6 else "".join(r.sample(KANJI, 2)) + r.choice("県府") + "".join(r.sample(KANJI, 2)) + r.choice("市町区")
            town = self.pick(STREETS_JA) if r.random() < 0.6 else "".join(r.sample(KANJI, r.choice([1, 2, 3])))
            a, b, c = r.randint(1, 9), r.randint(1, 30), r.randint(1, 30)
            return r.choice(["", "", f"〒{self.digits(3)}-{self.digits(4)} "]) + place + town + r.choice([f"{a}-{b}-{c}", f"{a}丁目{b}番{c}号", f"{a}-{b}", f"{a}丁目{b}-{c}"])
        s = self.pick(STREETS) if r.random() < 0.55 else self.family().split()[-1].title() if r.random() < 0.7 else self.r.choice(self.own_words).title()
        p = self.pick(PLACES) if r.random() < 0.55 else self.pick(BEGINS) + r.choice(["ton", "ville", "field", "bury", "ford", "port", "wood", "mouth", "-on-Sea"])
        line = f"{n}{r.choice(['', '', '', 'A', 'b'])} {r.choice(['', '', '', '', 'N. ', 'S. ', 'E. ', 'W. ', 'North ', 'Old '])}{s} {self.pick(KINDS_OF_STREET)}"
        unit = r.choice([f"Apt {r.randint(1, 99)}", f"Apt. {r.randint(1, 99)}", f"Suite {self.digits(3)}", f"Flat {r.randint(1, 40)}", f"Unit {r.randint(1, 40)}", f"#{r.randint(1, 99)}"])
        out = r.choice([line, line, f"{line}, {p}", f"{line}, {p}", f"{line}, {p}, {r.choice(['NY', 'CA', 'TX', 'OH', 'WA'])} {self.digits(5)}", f"{line}, {unit}, {p}", f"{line}, {unit}", f"{unit}, {line}, {p}", f"{line}\n{p}", f"{line}\n{unit}\n{p}", f"{line}, {p} {r.choice(['SW', 'N', 'LS', 'OX'])}{r.randint(1, 20)} {r.randint(1, 9)}AB", f"{line} in {p}"])
        y = r.random()
        return out.lower() if y < 0.06 else out.upper() if y < 0.08 else out

    def email(self) -> str:
        r = self.r
        flat = lambda x: "".join(c for c in x.lower().replace("ü", "ue").replace("ö", "oe").replace("ä", "ae") if c.isascii() and c.isalpha())
        g, s, w = flat(self.given()), flat(self.family()), self.r.choice(self.own_words)
        user = r.choice([f"{g}.{s}", f"{g}_{s}", f"{g}-{s}", f"{g}{s}", f"{g[0]}.{s}", f"{g[0]}{s}", f"{s}.{g}", f"{s}", g, f"{g}{r.randint(1, 99)}", f"{s}{r.randint(1, 2000)}", f"{g}.{s}{r.randint(1, 99)}", f"{w}.{self.r.choice(self.own_words)}", f"{w}{r.randint(1, 999)}", f"{w}_{g}", f"{g}+{w}", r.choice(["info", "office", "support", "hello", "contact", "sales"])])
        host = self.pick(HOSTS) if r.random() < 0.7 else f"{self.r.choice(self.own_words)}{r.choice(['', '-' + self.r.choice(self.own_words)])}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'jp', 'co.uk', 'test', 'example', 'eu'])}"
        x = r.random()
        if x < 0.5:
            out = f"{user}@{host}"
            return out.upper() if r.random() < 0.1 else out
        if x < 0.6:
            return f'<a href="mailto:{user}@{host}">{user}@{host}</a>'
        if x < 0.7:
            return f"{user}{r.choice(['&#64;', '&#64;', '&#x40;', '&commat;', '＠'])}{host}"
        if x < 0.74:
            return f"{user} @ {host}"
        at = r.choice([" (at) ", " [at] ", "(at)", "[at]", " at ", " AT ", " {at} ", "[AT]", "(AT)", " <at> "])
        dot = r.choice([" dot ", " DOT "]) if at in (" at ", " AT ") else r.choice([" (dot) ", " [dot] ", "(dot)", "[dot]", " dot ", ".", "."])
        return f"{user}{at}{host.replace('.', dot)}"

    def line(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A sentence with its blanks filled, and its labelled spans."""
        r = self.r
        template = self.loose() if r.random() < 0.35 else self.pick(LINES[r.choice(KINDS)]) if r.random() < 0.5 else self.pick(PLAIN)
        out, spans, at = "", [], 0
        while (i := template.find("{", at)) >= 0:
            j = template.index("}", i)
            out += template[at:i]
            kind, _, variant = template[i + 1:j].partition(":")
            at = j + 1
            if kind == "id":
                lead, value = self.id_number()
                out += lead
                kind = "id_number"
            elif kind in KINDS:
                value = {"email": lambda v: self.email(), "phone": self.phone, "address": self.address, "name": self.name}[kind](variant)
            else:
                out += self.r.choice(self.own_words) if kind == "w" else self.word() if kind == "W" else str(r.randint(1, 999)) if kind == "n" else str(r.randint(1, 59)) if kind == "n2" else self.digits(1) if kind == "d" else str(r.randint(1, 9)) + self.digits(int(kind[1:]) - 1)
                continue
            if kind == "email" and value.startswith("<a"):
                k = value.index("mailto:") + 7
                spans += [(len(out) + k, len(out) + value.index('">'), kind), (len(out) + value.index('">') + 2, len(out) + len(value) - 4, kind)]
            else:
                spans.append((len(out), len(out) + len(value), kind))
            out += value
        return out + template[at:], spans

    def loose(self) -> str:
        """A blank among words that don't go with it, so that an item is told by its own form; or none, or a single given name."""
        r = self.r
        some = lambda: " ".join(r.choice(self.own_words) for _ in range(r.choice([0, 1, 1, 2, 3, 4])))
        x = r.random()
        if x < 0.75:
            kind = r.choice(KINDS)
            item = "{id}" if kind == "id_number" else "{" + kind + r.choice({"address": ["", "", ":de", ":fr", ":es", ":ja"], "name": ["", "", "", "", ":ja"]}.get(kind, [""])) + "}"
        else:
            item = r.choice(["{W}", "{W} {W}", "{n8}", "{n6}", "{n4}-{n4}", "{n4} {n4}", "id {n4}-{n2}", "no. {n5}-{n3}", "{n2}:{n2}", "{n}.{n2}", "{n2} {w}s", "@{w}{n2}", "{w}.example.org", "The {W} {W}", "{w}", "{n4}", "{n10}", self.pick(GIVEN), self.pick(GIVEN), "{n} {w}", "{n2} {W}", "{n} {w}, {w}", "{n2} {W}, {w}", "{n} {w} {w}", "{n2} {w} {w}, {w}", "{w}-{w}", "{w}-{w} {w}", "{w}, {w}", "{n2} {W}, {W}", "{w} {w}"])
        before, after = some(), some()
        if r.random() < 0.4:
            before = before[:1].upper() + before[1:]
        return before + (r.choice([" ", " ", " ", ": ", ", "]) if before else "") + item + (r.choice(["", ",", "!", "?"]) if r.random() < 0.2 else "") + (" " + after if after else r.choice(["", ".", "!"]))

    def word(self) -> str:
        """A capitalized word that isn't part of a person's name: an ordinary one, or one that is made as family names are."""
        return self.r.choice(self.own_words).title() if self.r.random() < 0.6 else self.family().split()[-1]


def texts(n: int, seed: int = 5, part: str = "all", words: Sequence[str] = WORDS) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled texts of one to four sentences, put together as posts and comments are; ``words`` fill the blanks for words."""
    r = random.Random(seed)
    fill = _Filler(r, part, words)
    for _ in range(n):
        sep = r.choice([" ", " ", ". ", "\n", "\n", "\n\n", "<br>", "<br/>", "</p><p>", "</p>\n<p>"])
        out, spans = "<p>" if sep.startswith("</p>") else "", []
        for k in range(r.randint(1, 4)):
            if k:
                out += sep
            t, s = fill.line()
            spans += [(a + len(out), b + len(out), kind) for a, b, kind in s]
            out += t
        yield out + ("</p>" if sep.startswith("</p>") else ""), spans
