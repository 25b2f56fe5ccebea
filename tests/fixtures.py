"""Sample verses and expected values (fixed values)."""

VERSES = [
    ('Hymn 1.1', 1, ' अग्निमीळे पुरोहितं यज्ञस्य देवं रत्वीजम | होतारं रत्नधातमम ||', 'agnim īḻe purohitaṃ yajñasya devaṃ ratvījama | hotāraṃ ratnadhātamama ||'),
    ('Hymn 1.1', 3, ' अग्निना रयिमश्नवत्पोषमेव दिवेदिवे । यशसं वीरवत्तमम् ॥', ' agninā rayim aśnavat poṣam eva divedive | yaśasaṃ vīravattamam ||'),
    ('Hymn 1.1', 5, ' अग्निर्होता कविक्रतुः सत्यश्चित्रश्रवस्तमः | देवो देवेभिरा गमत् ॥', ' agnir hotā kavikratuḥ satyaś citraśravastamaḥ | devo devebhir ā gamat ||'),
    ('Hymn 1.1', 6, ' यदङ्ग दाशुषे त्वमग्ने भद्रं करिष्यसि | तवेतत्सत्यमङ्गिरः ॥', ' yad aṅga dāśuṣe tvam agne bhadraṃ kariṣyasi | tav etat satyam aṅgiraḥ ||'),
    ('Hymn 1.2', 1, ' वायवायाहि दर्शते । इमे सोमा अरंकृताः । तेभिः सूतास आ गहि ॥', ' vāyav ā yāhi darśata । ime somā araṃkṛtāḥ । tebhis sūtāsa ā gahi ॥'),
    ('Hymn 10.125', 1, ' अहं रुद्रेभिर्वसुभिश्चरामि । अहमादित्यैरुत विश्वदेवैः । अहं मित्रावरुणोभा बिभर्मि । अहमिन्द्राग्नी अहमश्विनोभा ॥', ' ahaṃ rudrebhir vasubhiś carāmi । aham ādityair uta viśvadevaiḥ । ahaṃ mitrāvaruṇobhā bibharmi । aham indrāgnī aham aśvinobhā ॥'),
    ('Hymn 10.125', 2, ' अहं सोममाहनसं बिभर्मि । अहं त्वष्टारमुत पूषणं भगम् । अहं दधामि द्रविणं हविष्मते । सुप्राव्ये यजमानाय सुन्वते ॥', ' ahaṃ somam āhanasaṃ bibharmi । ahaṃ tvaṣṭāram uta pūṣaṇaṃ bhagam । ahaṃ dadhāmi draviṇaṃ haviṣmate । suprāvye yajamānāya sunvate ॥'),
    ('Hymn 10.125', 3, ' अहं राष्ट्री संगमनी वसूनाम् । चिकितुषी प्रथमायज्ञियानाम् । तां मा देवा व्यदधुः पुरुत्रा । भूरिस्थात्रां भूर्यावेशयन्तीम् ॥', ' ahaṃ rāṣṭrī saṃgamanī vasūnām । cikitūṣī prathamā yajñiyānām । tāṃ mā devā vyadadhuḥ purutrā । bhūristhātrāṃ bhūry āveśayantīm ॥'),
    ('Hymn 10.125 Svaras', 1, ' अहं रुद्रेभिर् वसुभि श्चरामि । अहमा॑दित्यैरु॒त विश्वदे॑वैः । अहं मित्रावरुणो॒भा बि॑भर्मि । अहमेन्द्रा॒ग्नी अ॒हमश्वि॑नो॒भा ॥', ' ahaṃ rudrebhir vasubhiś carāmi । ahamā̍dityairu̱ta viśvade̍vaiḥ । ahaṃ mitrāvaruṇo̱bhā bi̍bharmi । ahamendrā̱gnī a̱hamaśvi̍no̱bhā ॥'),
    ('Hymn 10.125 Svaras', 6, ' अहं रु॒द्राय॒ धनु॒रात॑नोमि । ब्रह्म॒द्विषे॒ शर॑वे॒ हन्त॑वा उ । अहं ज॒नाय॒ सम॑दं कृणोमि । अहं द्या॒वापृ॑थि॒वी आ वि॑वेश ॥', ' ahaṃ ru̱drāya̱ dhanu̱rāta̍nomi । brahma̱dviṣe̱ śara̍ve̱ hanta̍vā u । ahaṃ ja̱nāya̱ sama̍daṃ kṛṇomi । ahaṃ dyā̱vā pṛ̍thi̱vī ā vi̍veśa ॥'),
]

# hymn, verse, meter, surface word, first and last-but-one Roman word, categories in order
SPANS = [
    ('Hymn 1.1', 1, 'Gayatri', 0, 0, 2, ['sandhi candidate']),
    ('Hymn 1.1', 3, 'Gayatri', 1, 1, 5, ['sandhi candidate', 'consonant sandhi', 'sandhi candidate']),
    ('Hymn 1.1', 5, 'Gayatri', 0, 0, 4, ['consonant sandhi', 'sandhi candidate', 'visarga sandhi']),
    ('Hymn 1.1', 5, 'Gayatri', 2, 5, 7, ['sandhi candidate']),
    ('Hymn 1.1', 6, 'No Meter Detected', 0, 0, 6, ['sandhi candidate', 'sandhi candidate', 'sandhi candidate', 'sandhi candidate', 'sandhi candidate']),
    ('Hymn 1.1', 6, 'No Meter Detected', 2, 7, 9, ['sandhi candidate']),
    ('Hymn 1.2', 1, 'Gayatri', 0, 0, 3, ['sandhi candidate', 'sandhi candidate']),
    ('Hymn 10.125', 1, 'Tristubh', 1, 1, 8, ['consonant sandhi', 'consonant sandhi', 'semivowel sandhi', 'sandhi candidate', 'sandhi candidate', 'sandhi candidate']),
    ('Hymn 10.125', 2, 'Tristubh-Jagati Mixed', 1, 1, 4, ['sandhi candidate', 'consonant sandhi']),
    ('Hymn 10.125', 3, 'Nicrd Tristubh', 3, 3, 6, ['consonant sandhi', 'sandhi candidate']),
    ('Hymn 10.125', 3, 'Nicrd Tristubh', 5, 7, 10, ['consonant sandhi', 'sandhi candidate']),
    ('Hymn 10.125', 3, 'Nicrd Tristubh', 9, 13, 15, ['sandhi candidate']),
    ('Hymn 10.125 Svaras', 6, 'Tristubh', 12, 12, 14, ['sandhi candidate']),
]
