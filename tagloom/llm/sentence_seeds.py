"""A small table of sentences with known borders, to train the sentence splitter on.

Everyday sentences that show what makes borders hard: abbreviations, initials, numbers, dates, quotations, brackets, dots in a
row. Placeholders: {n} a number, {d} a decimal, {v} a version, {w} a word, {N} a family name, {L} an initial. Each fifth
sentence of a language is held out where a part is asked for.
"""

SEEDS: dict[str, list[str]] = {
    "en": [
        "The train leaves at noon.", "She never liked the colour of that {w}.", "Bring an umbrella if it rains.", "Mr. {N} bought the house next door.", "Mrs. {N} and Ms. {N} share a garden.", "Dr. {N} will see you now.", "We met Prof. {N} at the station.", "St. {N} is a small town by the sea.", "Capt. {N} and Sgt. {N} were on board.", "Gen. {N} gave the order in {n}.", "Rev. {N} wrote the letter himself.", "Gov. {N} and Sen. {N} disagree.",
        "{L}. {N} won the race.", "The book is by {L}. {L}. {N}, not by her brother.", "{N}, {L}. is on the list.", "It was signed \"{L}. {N}\" in blue ink.", "See fig. {n} and tab. {n} below.", "The recipe is on p. {n} of the old book.", "Turn to pp. {n} and following.", "Vol. {n} is missing, but no. {n} is here.", "In ch. {n} the hero leaves, cf. the map.", "It opens at {n} a.m. on weekdays.", "The shop shuts at {n} p.m. sharp.", "We start at {n} a.m. and stop at {n} p.m. every day.", "The talks with the U.S. side went well.", "She lived in the U.K. until last year.", "The E.U. rules changed again.",
        "Bring pens, paper, tape, etc. to the class.", "They sell fruit, bread, milk, etc.", "Some birds, e.g. the {w} and the {w}, stay all winter.", "The second one, i.e. the larger, is mine.", "It was Smith vs. Jones in the final.", "It costs approx. {n} pounds.", "The flat has {n} rooms, incl. a kitchen.", "The firm {N} Inc. moved to the north.", "{N} Ltd. and {N} Co. have merged.", "He arrived on Jan. {n} and left on Feb. {n} without a word.", "Since Sept. {n} nobody has called.", "The rent rose by {d} percent in a year.", "The pill has {d} mg of iron.", "Prices fell from {d} to {d} in a week.", "A cup holds {d} l of water.", "It took {n},{n}00 steps to the top.", "The room was {d} m wide.", "Version {v} of the game is slow.", "Section {d} explains the rules.", "Her address is {w}.{w}@mail.example.com for now.", "Visit www.example.org for the timetable.", "The file {w}.txt is on the {w} drive.", "Save it as {w}_{n}.tar.gz before lunch.", "The host 10.{n}.0.{n} is down.",
        "\"Come in,\" said the nurse.", "\"Who is it?\" she whispered.", "\"Stop!\" cried the driver, but it was too late.", "\"It is late.\" was all he said.", "He asked, \"Where are my shoes?\"", "She answered: \"Under the bed. Where else?\"", "They shouted: \"Run! Hide!\"", "The sign says \"No dogs. No bikes.\" in red.", "I heard someone say \"maybe tomorrow...\" and then nothing.", "\"We won!\"", "“Did you call?” asked Tom.", "“Yes. Twice.” was the answer.", "He said, “I am tired.”", "The word 'never' is too strong.", "Press \"OK?\" and wait.",
        "The cat (it is old now) sleeps all day.", "The bill (see p. {n}) is wrong.", "Take the second road (not the first!) on the left.", "(The lift is out of order.)", "(Did you see that?)", "Nobody came (why?) to the door.", "The list [in Dr. {N}'s hand] is long.", "He waited... and waited.", "Well... I am not sure.", "And then it went dark...", "It was warm… almost hot.", "What?!", "Really?", "Why not!", "What a day!", "How many {w}s are left?", "Is this yours or mine?", "No!!!", "Who said so, and when?", "Wait; I will come with you.", "He paid; she did not.", "There are three kinds: red, green, and blue.", "Note: the {w} is fragile.",
        "{n} people came.", "{n} of the {n} seats were free.", "In {n} the bridge was rebuilt.", "The match ended {n}-{n} after extra time.", "It was No. {n} on the list.", "We are team no. {n}.", "They took route {n}.", "It has been empty since {n}.", "The score was {n}.", "I bought {n}.", "It was me.", "That is it.", "He told us.", "Let us go.", "I have a new one.", "We ate it up.", "It is on.", "Come with me.", "He said no.", "She is in.", "They went by.", "Give it to her.", "iPhones are sold here.", "eBay was slow today.", "The iPad broke.", "'Tis the season.", "Ring at Apt. {n} on the left.", "He lives on {N} Ave. near the park.", "Meet me at {N} Rd. at six.", "Mt. {N} is covered in snow.", "Ft. {N} is closed on Mondays.", "A Ph.D. is not required.", "She has a B.A. and an M.A. from Leeds.", "The speed limit is {n} km/h.", "The dog weighs {n} kg.", "It lasted {n} s.", "It lasted {d} s.", "The wall is {n} cm.", "THE DOOR IS LOCKED.", "DO NOT TOUCH!", "Please read the est. cost and the max. weight.", "The avg. age is {n}.", "We need min. {n} chairs.", "The dept. of Mr. {N} is upstairs.", "Rain is expected, esp. in the west.", "Jr. and Sr. {N} look alike.", "John {N} Jr. plays the drums.", "It is the {n}th floor.", "It is {n}% full.", "It costs ${d} a kilo.", "He came 1st, she came 2nd.", "Someone wrote \"what of the {w}\" on the wall.",
        "Smith et al. found the same.", "Col. {N} and Lt. {N} kept watch.", "Maj. {N} spoke first.", "Hon. {N} opened the bridge.", "{N} Bros. sell shoes.", "{N} Corp. closed in May.", "See sec. {n} and art. {n} of the law.", "It was built ca. {n} by monks.", "The ed. by {N} is better.", "Nos. {n} and {n} are sold.", "Call tel. {n} or ext. {n} now.", "Bake it for {n} min. at low heat.", "It weighs {n} lb. or so.", "The sq. footage is small.", "They left in Dec. and came back in Aug. of that year.", "On Mon. and Wed. we are closed.", "The orig. text is lost.", "Eq. {n} follows from eq. {n} above.", "The gate (approx. {n} m high) is shut.", "He asked \"Why?\" and left.", "\"Why?\" he asked, and left.", "She wrote \"Done.\" on the box and went home.", "They sang \"Happy days!\" all night.", "Is \"Wait here!\" a good name?", "The note (\"Back soon.\") was old.", "The \"No!\" was loud.", "The set has {n} cups, incl. {n} with a chip.", "The fare is {n} pounds, excl. {n} for the bag.", "It takes max. {n} minutes by bus.", "The crowd was est. {n} strong.", "Tickets, incl. {n} for children, are sold out.", "After that {n} more came.", "We lost. {n} of them won.", "It was late. {n} cars were left.", "In the end, {N} won.", "Then came {n}.", "Nobody saw the {w}.", "Who took my {w}?",
    ],
    "de": [
        "Der Zug fährt um zwölf.", "Das Wetter war schön.", "Herr Dr. {N} wohnt nebenan.", "Prof. {N} hält heute die Vorlesung.", "Hr. {N} und Fr. {N} sind verreist.", "St. {N} liegt am Fluss.", "Am {n}. Juni beginnt das Fest.", "Sie kommt am {n}. März zurück und bleibt bis zum {n}. April hier.", "Im {n}. Stock brennt Licht.", "Das war im {n}. Jahrhundert so üblich.", "Der {n}. Versuch klappte.", "Wir feiern am {n}.{n}. im Garten.", "Am {n}.{n}.{n} war Schluss.", "Er wohnt in der {N}str. {n} im Hof.", "Das Buch Nr. {n} fehlt.", "Siehe S. {n} und Abb. {n} unten.", "Vgl. Kap. {n} des Buches.", "Bd. {n} ist vergriffen.", "Es kostet ca. {n} Euro.", "Manche Vögel, z. B. Amseln, bleiben hier.", "Manche Tiere, z.B. Igel, schlafen.", "Er kam spät, d. h. nach elf.", "Sie mag Obst, u. a. Birnen.", "Das gilt bzw. galt für alle.", "Wir brauchen Brot, Käse, Milch usw.", "Brot, Käse usw. gibt es dort.", "Das ist evtl. zu viel.", "Der Preis inkl. Steuer beträgt {n} Euro.", "Die Firma {N} GmbH u. Co. zieht um.", "{L}. {N} hat gewonnen.", "Die o. g. Regel gilt.", "Es sind mind. {n} Stühle da.",
        "Die Miete stieg um {n},{n} Prozent.", "Das Dorf hat {n}.{n}00 Einwohner.", "Es ist {n}.{n} Uhr.", "Version {v} ist da.", "„Komm herein“, sagte sie.", "„Wer ist da?“ fragte der Junge.", "„Halt!“ rief er laut.", "„Es ist spät.“ sagte er leise.", "Sie fragte: „Wo sind meine Schuhe?“", "Er rief: „Lauft! Schnell!“", "Auf dem Schild steht „Kein Zutritt. Danke.“ in Rot.", "»Geh nach Hause.« sagte er.", "Die Katze (sie ist alt) schläft.", "(Der Aufzug ist kaputt.)", "Er wartete … und wartete.", "Dann wurde es dunkel …", "Na ja... vielleicht.", "Wie bitte?", "Wo ist der Schlüssel?", "Was für ein Tag!", "Nein!", "Er zahlt; sie nicht.", "{n} Leute kamen.", "{n} Stühle fehlen.", "Sie ist {n}.", "Das war {n}.", "Der Hund wiegt {n} kg.", "Es dauerte {n} s.", "Ich nehme zwei.", "Er sah es.", "Das Auto fuhr an.", "Sie rief ihn an.", "Jemand schrieb „wohin mit dem Rest“ an die Wand.", "Der Arzt, Hr. Dr. {N}, hat Urlaub.", "Die Str. ist gesperrt.", "Das Haus ist ggf. frei.", "Um {n} Uhr ist Schluss.",
    ],
    "fr": [
        "Le train part à midi.", "Il fait beau ce matin.", "M. {N} habite à côté.", "Mme {N} et Mlle {N} sont parties.", "MM. {N} et {N} arrivent demain.", "Le Dr {N} est malade.", "Le Pr. {N} donne un cours.", "{L}. {N} a gagné la course.", "J.-{L}. {N} a écrit ce livre.", "Voir p. {n} et fig. {n} plus bas.", "Cf. le chap. {n} du livre.", "Le vol. {n} manque.", "Il faut du pain, du lait, etc.", "Le pain, le lait, etc. sont là.", "Certains oiseaux, p. ex. le merle, restent ici.", "Le second, c.-à-d. le plus grand, est à moi.", "Cela coûte env. {n} euros.", "C'est au no. {n} de la rue.", "Le n° {n} est vide.", "Il habite au {n}, av. {N}, près du parc.", "Le loyer a monté de {n},{n} pour cent.", "La version {v} est lente.", "Il est {n} h {n} à la gare.", "Le chien pèse {n} kg.", "Cela a duré {n} s.",
        "« Entrez », dit l'infirmière.", "« Qui est-ce ? » demanda-t-il.", "« Arrêtez ! » cria le chauffeur.", "« Il est tard. » dit-il tout bas.", "Elle demanda : « Où sont mes clés ? »", "Il cria : « Courez ! Vite ! »", "Le panneau dit « Pas de chiens. Merci. » en rouge.", "\"Venez !\" dit le voisin.", "Le chat (il est vieux) dort.", "(L'ascenseur est en panne.)", "Il attendait… et attendait.", "Et puis il fit noir…", "Bon... on verra.", "Pourquoi pas ?", "Où est la clé ?", "Quelle journée !", "Non !", "Il paie ; elle non.", "{n} personnes sont venues.", "En {n}, le pont fut refait.", "Elle a {n} ans.", "Il en reste {n}.", "C'est à moi.", "Il l'a vu.", "On y va.", "Quelqu'un a écrit « que faire du reste » sur le mur.", "St. {N} est un village.", "Le bus arrive à {n} h.", "Les invités : Paul, Anne et Luc.",
    ],
    "es": [
        "El tren sale a mediodía.", "Hoy hace buen tiempo.", "El Sr. {N} vive al lado.", "La Sra. {N} y la Srta. {N} se han ido.", "El Dr. {N} está enfermo.", "La Dra. {N} llega hoy.", "El Prof. {N} da una clase.", "D. {N} y Dña. {N} viajan mucho.", "{L}. {N} ganó la carrera.", "Ud. puede pasar.", "Uds. no han pagado.", "Los EE. UU. firmaron el acuerdo.", "Véase la pág. {n} y la fig. {n} abajo.", "Cf. el cap. {n} del libro.", "El vol. {n} falta.", "Hace falta pan, leche, etc.", "El pan, la leche, etc. están ahí.", "Algunas aves, p. ej. el mirlo, se quedan.", "El segundo, es decir, el mayor, es mío.", "Cuesta aprox. {n} euros.", "Vive en el núm. {n} de la calle.", "Está en la Av. {N} junto al parque.", "Abre a las {n} a. m. cada día.", "Cierra a las {n} p. m. en punto.", "El alquiler subió un {n},{n} por ciento.", "La versión {v} es lenta.", "El perro pesa {n} kg.", "Duró {n} s.",
        "«Pase», dijo la enfermera.", "«¿Quién es?» preguntó él.", "«¡Alto!» gritó el conductor.", "«Es tarde.» dijo en voz baja.", "Ella preguntó: «¿Dónde están mis llaves?»", "Él gritó: «¡Corran! ¡Rápido!»", "El cartel dice «Sin perros. Gracias.» en rojo.", "\"¡Venga!\" dijo el vecino.", "El gato (es viejo) duerme.", "(El ascensor no funciona.)", "Esperaba... y esperaba.", "Y luego se hizo de noche...", "Bueno… ya veremos.", "¿Por qué no?", "¿Dónde está la llave?", "¡Qué día!", "¡No!", "¿Y si no viene nadie?", "Él paga; ella no.", "Vinieron {n} personas.", "En {n} se rehízo el puente.", "Tiene {n} años.", "Quedan {n}.", "Es mío.", "Lo vio.", "Vámonos ya.", "{n} sillas faltan.", "Alguien escribió «qué hacer con el resto» en la pared.", "Los invitados: Pablo, Ana y Luis.",
    ],
    "ru": [
        "Поезд уходит в полдень.", "Сегодня хорошая погода.", "Г-н {N} живёт рядом.", "Проф. {Nr} читает лекцию.", "Д-р {Nr} болен.", "{Lr}. {Nr} выиграл гонку.", "Книгу написал {Lr}. {Lr}. {Nr}, а не его брат.", "См. стр. {n} и рис. {n} ниже.", "Ср. гл. {n} этой книги.", "Нужны хлеб, молоко и т. д.", "Хлеб, молоко и т. д. уже здесь.", "Были яблоки, груши и т. п.", "Второй, т. е. больший, мой.", "Некоторые птицы, т. к. тепло, остались.", "Это стоит ок. {n} рублей.", "В {n} г. мост построили заново.", "Он родился в {n} г. в деревне.", "Он живёт на ул. {Nr} у парка.", "Дом № {n} пуст.", "Плата выросла на {n},{n} процента.", "В селе {n} тыс. жителей.", "Версия {v} медленная.", "Собака весит {n} кг.",
        "«Войдите», — сказала сестра.", "«Кто там?» спросил он.", "«Стой!» крикнул водитель.", "«Уже поздно.» сказал он тихо.", "Она спросила: «Где мои ключи?»", "Он крикнул: «Бегите! Быстро!»", "На двери надпись «Не входить. Спасибо.» красным.", "Кот (он старый) спит.", "(Лифт не работает.)", "Он ждал… и ждал.", "Потом стало темно…", "Ну... посмотрим.", "Почему бы и нет?", "Где ключ?", "Какой день!", "Нет!", "Он платит; она нет.", "{n} человек пришли.", "Осталось {n}.", "Это моё.", "Он видел.", "Пойдём.", "Ей {n} лет.", "Кто-то написал «куда деть остаток» на стене.", "Пришли Иванов, Попов и др. гости.", "Были книги, журналы и др.", "Были столы, стулья и пр.", "В {n}–{n} гг. тут был рынок.", "Это было в {n} в. до нашей эры.", "Музей им. {Nr} закрыт.", "Это стоит {n} руб. за штуку.", "Напр. кошки спят днём.", "Акад. {Nr} и доц. {Nr} спорили.", "Табл. {n} и прил. {n} в конце.", "Квартира {n}, д. {n}, корп. {n} пуста.", "Пл. {Nr} перекрыта.", "Ждали {n} мин. у входа.", "Т. н. новый дом стар.", "Он спросил «Зачем?» и ушёл.", "«Зачем?» спросил он и ушёл.", "Она написала «Готово.» на коробке и ушла.", "Дорога (ок. {n} км) закрыта.", "В {n} году открыли школу.", "У нас {n} стульев.", "Стр. {n} пуста.", "Рис. {n} нечёткий.",
    ],
    "el": [
        "Το τρένο φεύγει το μεσημέρι.", "Σήμερα έχει καλό καιρό.", "Ο κ. {N} μένει δίπλα.", "Η κα. {N} έφυγε.", "Ο Δρ. {N} είναι άρρωστος.", "Ο καθ. {N} διδάσκει.", "Βλ. σελ. {n} και εικ. {n} πιο κάτω.", "Δείτε το κεφ. {n} του βιβλίου.", "Θέλουμε ψωμί, γάλα κ.λπ.", "Ψωμί, γάλα κ.λπ. υπάρχουν.", "Μερικά πουλιά, π.χ. τα σπουργίτια, μένουν.", "Το δεύτερο, δηλ. το μεγάλο, είναι δικό μου.", "Κοστίζει περ. {n} ευρώ.", "Το {n} μ.Χ. έγινε πόλεμος.", "Το ενοίκιο ανέβηκε {n},{n} τοις εκατό.", "Η έκδοση {v} είναι αργή.", "Ποιος είναι;", "Πού είναι το κλειδί;", "Γιατί όχι;", "Θα έρθεις αύριο ή μεθαύριο;", "Τι μέρα!", "Όχι!", "«Περάστε», είπε η νοσοκόμα.", "«Ποιος είναι;» ρώτησε.", "«Είναι αργά.» είπε σιγά.", "Ρώτησε: «Πού είναι τα κλειδιά μου;»", "Φώναξε: «Τρέξτε! Γρήγορα!»", "Η γάτα (είναι γριά) κοιμάται.", "(Το ασανσέρ χάλασε.)", "Περίμενε… και περίμενε.", "Μετά σκοτείνιασε…", "Αυτός πληρώνει· εκείνη όχι.", "Ήρθαν {n} άτομα.", "Έμειναν {n}.", "Είναι δικό μου.", "Το {n} έγινε η γέφυρα.",
    ],
    "hi": [
        "रेल दोपहर को जाती है।", "आज मौसम अच्छा है।", "डॉ. {N} बीमार हैं।", "श्री. {N} पास में रहते हैं।", "प्रो. {N} पढ़ाते हैं।", "पृ. {n} देखिए।", "किराया {d} प्रतिशत बढ़ा।", "संस्करण {v} धीमा है।", "कौन है?", "चाबी कहाँ है?", "क्यों नहीं?", "क्या दिन है!", "नहीं!", "\"अंदर आइए।\" नर्स ने कहा।", "\"कौन है?\" उसने पूछा।", "उसने पूछा: \"मेरी चाबी कहाँ है?\"", "“रुको!” चालक चिल्लाया।", "बिल्ली (वह बूढ़ी है) सो रही है।", "(लिफ्ट बंद है।)", "वह इंतज़ार करता रहा… और करता रहा।", "वह देता है; वह नहीं।", "{n} लोग आए।", "सन् {n} में पुल बना।", "उसने रोटी, दूध आदि खरीदे।", "कुत्ते का वज़न {n} किलो है।", "यह मेरा है।", "सब ठीक है, चलो।", "दुकान {n} बजे खुलती है।",
    ],
    "ar": [
        "يغادر القطار عند الظهر.", "الطقس جميل اليوم.", "د. {N} مريض اليوم.", "أ. {N} يسكن قريبا.", "انظر ص. {n} من الكتاب.", "ارتفع الإيجار {d} في المئة.", "الإصدار {v} بطيء.", "من هناك؟", "أين المفتاح؟", "لم لا؟", "يا له من يوم!", "لا!", "«تفضل»، قالت الممرضة.", "«من هناك؟» سأل الولد.", "«الوقت متأخر.» قال بهدوء.", "سألت: «أين مفاتيحي؟»", "صاح: «اركضوا! بسرعة!»", "القط (وهو عجوز) نائم.", "(المصعد معطل.)", "انتظر… وانتظر.", "هو يدفع؛ أما هي فلا.", "جاء {n} شخصا.", "في عام {n} بني الجسر.", "اشترى الخبز، والحليب، إلخ.", "يزن الكلب {n} كيلو.", "هذا لي.", "هيا بنا.", "يفتح المحل الساعة {n} صباحا.",
    ],
    "zh": [
        "火车中午开。", "今天天气很好。", "李医生住在隔壁。", "请看第{n}页。", "房租涨了{d}％。", "这只狗有{n}公斤。", "版本{v}很慢。", "是谁？", "钥匙在哪里？", "为什么不呢？", "多好的一天！", "不！", "“请进。”护士说。", "“是谁？”他小声问。", "“停下！”司机喊道。", "她问：“我的鞋在哪里？”", "他喊：“快跑！快！”", "牌子上写着“请勿入内。谢谢。”几个红字。", "“我们赢了！”", "他说“明天吧……”就挂了电话。", "猫（它老了）在睡觉。", "（电梯坏了。）", "他等着……等着。", "后来天黑了……", "他付钱；她不付。", "来了{n}个人。", "{n}年桥重建了。", "有三种：红的、绿的和蓝的。", "这是我的。", "走吧。", "商店{n}点开门。", "有人在墙上写了“剩下的怎么办”。", "「你好。」他说。", "他只说了“不！”就走了。", "他问“为什么？”然后走了。", "“为什么？”他问完就走了。", "她在盒子上写了“好了。”才回家。", "他们整夜唱“好日子！”这首歌。", "门上的“小心！”很大。", "纸条（“马上回来。”）很旧。", "他喊了一声“等等！”，没人理他。", "老师说：“坐下。”", "老师说：“坐下。”学生坐下了。", "“太晚了！”", "今天是{n}月{n}日。", "书名是《山和水》。", "他看了《山和水！》这部电影。", "水温是{d}度。", "一共{n}页，缺{n}页。", "你好吗？", "我不知道。", "图中有一座山（远处。）和一条河。",
    ],
    "ja": [
        "電車は正午に出ます。", "今日はいい天気です。", "山田さんは隣に住んでいます。", "{n}ページを見てください。", "家賃が{d}％上がりました。", "犬は{n}キロです。", "版{v}は遅いです。", "どなたですか？", "鍵はどこですか。", "どうして？", "なんて日だ！", "いいえ！", "「どうぞ。」と看護師が言いました。", "「誰？」と彼は聞いた。", "「止まれ！」と運転手が叫んだ。", "彼女は聞いた：「私の靴はどこ？」", "彼は「走れ！早く！」と叫びました。", "札には「入るな。危険。」と書いてあります。", "「勝った！」", "彼は「また明日…」と言って電話を切った。", "猫（もう年です）は寝ています。", "（エレベーターは故障中です。）", "彼は待った…ずっと待った。", "それから暗くなった…。", "三種類あります：赤、緑、青です。", "{n}人来ました。", "{n}年に橋ができました。", "これは私のです。", "行きましょう。", "店は{n}時に開きます。", "誰かが壁に「残りはどうする」と書いた。", "『静かに。』と母が言った。", "彼は「なぜ？」と聞いて出て行った。", "箱に「済み。」と書いて帰った。", "扉の「注意！」は大きい。", "紙（「すぐ戻る。」）は古い。", "先生は言った：「座って。」", "「遅すぎる！」", "気温は{d}度です。", "知りません。", "えっ！？",
    ],
    "th": ["รถไฟออกตอนเที่ยง", "วันนี้อากาศดี", "บ้านนี้มี {n} ห้อง", "รุ่น {v} ช้ามาก", "กุญแจอยู่ที่ไหน", "สุนัขหนัก {n} กิโล", "ร้านเปิดแต่เช้า", "แมวหลับอยู่", "ลิฟต์เสีย", "มีคนมา {n} คน", "ค่าเช่าขึ้น {d} เปอร์เซ็นต์", "ไปกันเถอะ"],
}

WORDS = "apple table window paper coffee mountain silver kettle pencil ladder rabbit ribbon carpet candle bottle hammer forest ticket jacket bucket".split()
NAMES = "Smith Johnson Miller Baker Carter Walker Young Wright Collins Murphy Weber Fischer Martin Dubois García López Rossi Novak Hansen Silva".split()
NAMES_RU = "Иванов Смирнова Кузнецов Попова Соколов Лебедева".split()
