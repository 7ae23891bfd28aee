"""Fixed word lists of the text scores.  Results depend on their exact members."""
ARTICLES = ["a", "an", "the"]
SIMPLE = ["a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
DEGREE = ["very", "really", "quite", "extremely"]
JOINERS = ["and", "or", "but"]
CONJUNCTIONS = ["and", "but", "or", "so", "because", "although", "while", "if", "when", "since"]
SHORT_PREPOSITIONS = ["of", "in", "on", "at", "to", "for", "with", "by"]
QUESTION_STARTS = ["what", "where", "when", "why", "how", "who"]
QUESTION_WORDS = ["what", "where", "when", "why", "how", "who", "which", "whose"]
UNLIKELY_PAIRS = ["i are", "you am", "they is", "we is", "and and", "but but", "or or"]
TOPIC_STOP = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was",
              "were", "be", "been", "have", "has", "had", "will", "would", "could", "should"]
THIRD_PERSON = ["he", "she", "it", "they", "him", "her", "them", "his", "hers", "its", "their", "theirs"]
PAST = ["was", "were", "had", "did", "went", "came", "said", "told", "asked"]
PRESENT = ["is", "are", "do", "does", "go", "come", "say", "tell", "ask"]
FUTURE = ["will", "would", "going to", "gonna"]
NAME_ENDINGS = r"(son|sen|ton|ham|ford|burg|wick|worth|field|wood|land|stein|berg|man|er|ing|ly|ia|ica)$"
NOT_NAMES = ["and", "the", "but", "for", "not", "you", "are", "can", "will", "was", "has", "had"]
PLACE_NAMES = r"(son|sen|ton|ham|ford|burg|wick|worth|field|wood|land|stein|berg|man|ia|ica|ville|town|city)$"
COMMON_LOWER = ["and", "the", "but", "for", "not", "you", "are", "can", "will", "was", "has", "had", "with", "from",
                "they", "this", "that", "there", "their"]
PREPOSITIONS = ["in", "on", "at", "to", "for", "of", "with", "by", "from", "about", "into", "through", "during", "before",
                "after", "above", "below", "between", "among"]
PRONOUNS = ["i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its",
            "our", "their"]
AUXILIARIES = ["is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did",
               "will", "would", "could", "should", "might", "may", "can"]
ABBREVIATIONS = ["dr", "mr", "mrs", "ms", "prof", "inc", "corp", "ltd", "etc", "vs", "ie", "eg"]
TITLE_FUNCTION = ["The", "A", "An", "And", "Or", "But", "Of", "In", "On", "At", "To", "For", "With", "By"]
LOWER_CASE_WORDS = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was",
                    "were", "be", "been", "have", "has", "had", "will", "would", "could", "should", "can", "may", "might",
                    "this", "that", "these", "those", "there", "their", "they", "them", "you", "your", "we", "our", "us",
                    "i", "me", "my"]
ACRONYMS = ["AI", "API", "CEO", "CTO", "USA", "UK", "EU", "UN", "NASA", "FBI", "CIA", "IBM", "IT", "HR", "PR", "TV", "CD",
            "DVD", "GPS", "DNA", "RNA"]
FILLERS = ["um", "uh", "er", "ah", "eh", "mm", "hmm", "hm", "mhm", "umm", "uhh", "err", "ahh", "ohh", "mmm"]
DISCOURSE = ["you know", "i mean", "like", "so", "well", "right", "okay", "i guess", "kind of", "sort of", "i think",
             "actually", "basically", "literally", "honestly", "obviously"]
FALSE_STARTS = ["i was", "we were", "they are", "it is", "that was", "he said", "she said", "we had", "i had", "they had"]
HESITATIONS = ["erm", "emm", "mmhmm", "uh-huh", "mm-hmm", "yeah", "yes", "no", "nah", "yep", "yup", "sure", "ok", "alright"]
CORRECTIONS = ["no", "sorry", "wait", "actually", "rather"]
START_PHRASES = ["i was going to", "we were trying to", "i thought that", "what i wanted to", "the thing is", "i mean"]
RESTARTS = ["let me", "what i", "so basically", "okay so", "well actually"]
PAUSES = ["[pause]", "(pause)", "[silence]", "(silence)", "[inaudible]", "(inaudible)", "[crosstalk]", "(crosstalk)",
          "...", "….", "..", "—", "–"]
BACKCHANNELS = ["yeah", "yes", "mm-hmm", "uh-huh", "okay", "right", "sure"]
CONTRACTED = r"[\p{L}\p{N}_]+(?:n't|'ll|'re|'ve|'m|'s|'d)(?:[^\p{L}\p{N}_]|$)"
UNCONTRACTED = r"[\p{L}\p{N}_]+(?:nt|ll|re|ve|m|s|d)(?:[^\p{L}\p{N}_]|$)"
