"""Prompts and chat rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt texts of the transcript format.
SYSTEM_PROMPT = """You are a research assistant that answers complex questions by searching for information step by step.

## How to work
1. Wrap ALL your reasoning inside <think>...</think> tags.
2. When you need to look up a fact, emit <search>your query</search>.
   - The system will automatically retrieve relevant passages and return them inside <results>...</results>. You do NOT generate the results yourself.
3. After reading results, continue reasoning inside <think>...</think>.
4. Repeat search-then-think as many times as needed.
5. When you have enough information, write your final answer on a line starting with "Answer: ".

## Rules
- Every search query must be a short, specific keyword query (3-10 words).
- Do NOT fabricate facts. If search results are insufficient, search again with a different query.
- You may search up to 10 times. Use as few searches as needed.
- Always show your reasoning before and after each search."""
USER_PREFIX = "Answer the following question by searching for information step by step.\n\nQuestion: "
FEW_SHOT = (
    ("user", "Answer the following question by searching for information step by step.\n\nQuestion: What is the capital of the country where the Zambezi River ends?"),
    (
        "assistant",
        """<think>
I need to find where the Zambezi River ends (its mouth), then determine which country that is in, and finally find the capital of that country. I don't know this from memory, so I must search for it.
</think>
<search>Zambezi River mouth location</search>
<results>
[1] The Zambezi is the fourth-longest river in Africa. It rises in Zambia and flows through eastern Angola, Namibia, Botswana, Zambia, Zimbabwe, and Mozambique, emptying into the Indian Ocean near the city of Quelimane in Mozambique.
</results>
<think>
The search results show that the Zambezi River empties into the Indian Ocean in Mozambique. So the country where it ends is Mozambique. Now I need to search for the capital of Mozambique.
</think>
<search>capital of Mozambique</search>
<results>
[1] Maputo is the capital and largest city of Mozambique. It is located on the western shore of Maputo Bay.
</results>
<think>
The search confirms that the capital of Mozambique is Maputo. I have the complete chain: Zambezi ends in Mozambique, capital is Maputo.
</think>
Answer: Maputo""",
    ),
    ("user", "Answer the following question by searching for information step by step.\n\nQuestion: Were the directors of Stalker and Nostalghia born in the same country?"),
    (
        "assistant",
        """<think>
I need to find the directors of these two films, then check if they were born in the same country. I should not guess — let me search for each.
</think>
<search>director of Stalker 1979 film</search>
<results>
[1] Stalker is a 1979 Soviet science fiction art film directed by Andrei Tarkovsky, loosely based on the novel Roadside Picnic by Arkady and Boris Strugatsky.
</results>
<think>
Stalker was directed by Andrei Tarkovsky. Now I need to search for the director of Nostalghia.
</think>
<search>director of Nostalghia 1983 film</search>
<results>
[1] Nostalghia is a 1983 art film directed by Andrei Tarkovsky. It was Tarkovsky's first film made outside the Soviet Union, produced in Italy.
</results>
<think>
Both films were directed by Andrei Tarkovsky. Since it's the same person, they were obviously born in the same country. But let me confirm his birthplace with a search to give a complete answer.
</think>
<search>Andrei Tarkovsky birthplace</search>
<results>
[1] Andrei Arsenyevich Tarkovsky was born on 4 April 1932 in Zavrazhye, Yuryevetsky District, Ivanovo Industrial Oblast, Soviet Union (now Russia).
</results>
<think>
Confirmed: both films were directed by Andrei Tarkovsky, born in the Soviet Union (now Russia). The answer is yes.
</think>
Answer: Yes, both Stalker and Nostalghia were directed by Andrei Tarkovsky, who was born in the Soviet Union (Zavrazhye, now Russia).""",
    ),
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def search_prompt(question: Column | str, few_shot: bool = True) -> Column:
    """The chat messages that ask for a transcript; question is never formatted, so any character may be in it."""
    question = F.col(question) if isinstance(question, str) else question
    shots = [message(r, F.lit(c)) for r, c in FEW_SHOT] if few_shot else []
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), *shots, message("user", F.concat(F.lit(USER_PREFIX), question)))


def sft_messages(question: Column | str, text: Column | str) -> Column:
    """A transcript as a conversation of one turn."""
    question, text = (F.col(c) if isinstance(c, str) else c for c in (question, text))
    return F.array(message("user", F.concat(F.lit(USER_PREFIX), question)), message("assistant", text))


def render_chat(messages: Column, before: str = "<|im_start|>", after: str = "<|im_end|>\n") -> Column:
    """A simple chat template: role, line feed, content, between two marks. Models have their own; pass their marks."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(before), m["role"], F.lit("\n"), m["content"], F.lit(after))), "")
