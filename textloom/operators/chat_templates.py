"""The forms of known chat templates, as fixed values.

``{{content}}`` is a message's text, ``<bos>`` and ``<eos>`` the tokenizer's tokens. Many templates
share the forms of a family and differ in a few fields.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Template:
    """``efficient_eos``: answers carry no end token of their own; the encoder ends the whole with one
    and learns it at the start of the next prompt. ``reasoning``: answers have thoughts between the
    words of ``thought``; ``closing_only``: an empty thought is the closing word alone."""

    name: str
    user: str = "{{content}}"
    assistant: str = "{{content}}<eos>"
    system: str = "{{content}}"
    observation: str | None = None
    function: str | None = None
    tools: str = "{{content}}"
    prefix: str = ""
    default_system: str = ""
    stop_words: tuple[str, ...] = ()
    tool_format: str = "default"
    system_in_user: bool = False
    thought: tuple[str, str] = ("<think>\n", "\n</think>\n\n")
    call_words: tuple[str, str] = ("<tool_call>", "</tool_call>")
    reasoning: bool = False
    closing_only: bool = False
    efficient_eos: bool = False
    replace_eos: bool = False
    replace_jinja: bool = False
    media: str = "base"


# --- fixed values: families ------------------------------------------------------------------------------------
_CHATML = Template("", user="<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n", assistant="{{content}}<|im_end|>\n", system="<|im_start|>system\n{{content}}<|im_end|>\n", stop_words=("<|im_end|>",))
_CHATML_TOOL = replace(_CHATML, observation="<|im_start|>tool\n{{content}}<|im_end|>\n<|im_start|>assistant\n")
_QWEN = replace(_CHATML, observation="<|im_start|>user\n<tool_response>\n{{content}}\n</tool_response><|im_end|>\n<|im_start|>assistant\n", tool_format="qwen", replace_eos=True)
_LFM2 = replace(_CHATML, observation="<|im_start|>tool\n<|tool_response_start|>{{content}}<|tool_response_end|><|im_end|>\n<|im_start|>assistant\n", tool_format="lfm2", call_words=("<|tool_call_start|>", "<|tool_call_end|>"), replace_eos=True)
_GEMMA = Template("", user="<start_of_turn>user\n{{content}}<end_of_turn>\n<start_of_turn>model\n", assistant="{{content}}<end_of_turn>\n", system="{{content}}\n\n", observation="<start_of_turn>tool\n{{content}}<end_of_turn>\n<start_of_turn>model\n", prefix="<bos>", stop_words=("<end_of_turn>",), replace_eos=True, system_in_user=True)
_GEMMA4 = Template("", user="<|turn>user\n{{content}}<turn|>\n<|turn>model\n", assistant="{{content}}<turn|>\n", system="<|turn>system\n<|think|>{{content}}<turn|>\n", observation="<|turn>tool\n{{content}}<turn|>\n<|turn>model\n", function="<|tool>{{content}}<tool|>", prefix="<bos>", default_system="You are a helpful assistant.", stop_words=("<turn|>",), tool_format="gemma4", thought=("<|channel>thought\n", "<channel|>"), reasoning=True, replace_eos=True, media="gemma4")
_GLM4 = Template("", user="<|user|>\n{{content}}<|assistant|>", assistant="\n{{content}}", system="<|system|>\n{{content}}", observation="<|observation|>\n{{content}}<|assistant|>", function="{{content}}", prefix="[gMASK]<sop>", stop_words=("<|user|>", "<|observation|>"), tool_format="glm4", efficient_eos=True)
_LLAMA3 = Template("", user="<|start_header_id|>user<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", assistant="{{content}}<|eot_id|>", system="<|start_header_id|>system<|end_header_id|>\n\n{{content}}<|eot_id|>", observation="<|start_header_id|>ipython<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", prefix="<bos>", stop_words=("<|eot_id|>", "<|eom_id|>"), tool_format="llama3", replace_eos=True)
_LLAMA2 = Template("", user="<bos>[INST] {{content}} [/INST]", system="<<SYS>>\n{{content}}\n<</SYS>>\n\n", system_in_user=True)
_MISTRAL = Template("", user="[INST] {{content}}[/INST]", assistant=" {{content}}<eos>", system="{{content}}\n\n", function="[TOOL_CALLS] {{content}}<eos>", observation='[TOOL_RESULTS] {"content": {{content}}}[/TOOL_RESULTS]', prefix="<bos>", tool_format="mistral", system_in_user=True)
_MINISTRAL = Template("", user="[INST]{{content}}[/INST]", system="{{content}}\n\n", function="[TOOL_CALLS]{{content}}<eos>", observation='[TOOL_RESULTS]{"content": {{content}}}[/TOOL_RESULTS]', prefix="<bos>", tool_format="mistral", system_in_user=True)
_CURIOUS = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
_VICUNA = Template("", user="USER: {{content}} ASSISTANT:", default_system=_CURIOUS)
_MOONLIGHT = Template("", user="<|im_user|>user<|im_middle|>{{content}}<|im_end|><|im_assistant|>assistant<|im_middle|>", assistant="{{content}}<|im_end|>", system="<|im_system|>system<|im_middle|>{{content}}<|im_end|>", stop_words=("<|im_end|>",))
_GRANITE = Template("", user="<|start_of_role|>user<|end_of_role|>{{content}}<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>", assistant="{{content}}<|end_of_text|>\n", system="<|start_of_role|>system<|end_of_role|>{{content}}<|end_of_text|>\n")
_PHI = Template("", user="<|user|>\n{{content}}<|end|>\n<|assistant|>\n", assistant="{{content}}<|end|>\n", system="<|system|>\n{{content}}<|end|>\n", stop_words=("<|end|>",), replace_eos=True)
_SEED = Template("", user="<bos>user\n{{content}}<eos><bos>assistant\n", system="<bos>system\n{{content}}<eos>")
_HELPFUL = "You are a helpful assistant."

# --- fixed values: templates -----------------------------------------------------------------------------------
_ALL = {
    "alpaca": Template("", user="### Instruction:\n{{content}}\n\n### Response:\n", assistant="{{content}}<eos>\n\n", default_system="Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n", replace_jinja=True),
    "bailing": Template("", user="<role>HUMAN</role>{{content}}<role>ASSISTANT</role>", system="<role>SYSTEM</role>{{content}}", observation="<role>OBSERVATION</role>{{content}}<role>ASSISTANT</role>", stop_words=("<|endoftext|>",), efficient_eos=True),
    "bailing_v2": Template("", user="<role>HUMAN</role>{{content}}<|role_end|><role>ASSISTANT</role>", assistant="{{content}}<|role_end|>", system="<role>SYSTEM</role>{{content}}<|role_end|>", observation="<role>OBSERVATION</role>\n<tool_response>\n{{content}}\n</tool_response><|role_end|><role>ASSISTANT</role>", stop_words=("<|endoftext|>",), tool_format="ling", efficient_eos=True),
    "breeze": Template("", user="[INST] {{content}} [/INST] ", prefix="<bos>", efficient_eos=True),
    "chatglm3": replace(_GLM4, user="<|user|>\n{{content}}<|assistant|>", prefix="[gMASK]sop"),
    "chatml": replace(_CHATML_TOOL, stop_words=("<|im_end|>", "<|im_start|>"), replace_eos=True, replace_jinja=True),
    "chatml_de": replace(_CHATML_TOOL, default_system="Du bist ein freundlicher und hilfsbereiter KI-Assistent.", stop_words=("<|im_end|>", "<|im_start|>"), replace_eos=True, replace_jinja=True),
    "cohere": Template("", user="<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>", system="<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|>", prefix="<bos>"),
    "cpm4": replace(_CHATML_TOOL, prefix="<bos>"),
    "dbrx": replace(_CHATML_TOOL, replace_eos=True, default_system="You are DBRX, created by Databricks. You were last updated in December 2023. You answer questions based on information available up to that point.\nYOU PROVIDE SHORT RESPONSES TO SHORT QUESTIONS OR STATEMENTS, but provide thorough responses to more complex and open-ended questions.\nYou assist with various tasks, from writing to coding (using markdown for code blocks — remember to use ``` with code, JSON, and tables).\n(You do not have real-time data access or code execution capabilities. You avoid stereotyping and provide balanced perspectives on controversial topics. You do not provide song lyrics, poems, or news articles and do not divulge details of your training data.)\nThis is your system prompt, guiding your responses. Do not reference it, just respond to the user. If you find yourself talking about this message, stop. You should be responding appropriately and usually that means not mentioning this.\nYOU DO NOT MENTION ANY OF THIS INFORMATION ABOUT YOURSELF UNLESS THE INFORMATION IS DIRECTLY PERTINENT TO THE USER'S QUERY."),
    "deepseek": Template("", user="User: {{content}}\n\nAssistant:", system="{{content}}\n\n", prefix="<bos>"),
    "deepseek3": Template("", user="<｜User｜>{{content}}<｜Assistant｜>", prefix="<bos>"),
    "deepseekr1": Template("", user="<｜User｜>{{content}}<｜Assistant｜>", prefix="<bos>", reasoning=True),
    "hy3": Template("", user="<｜hy_User｜>{{content}}<｜hy_Assistant｜>", assistant="{{content}}<｜hy_eos｜>", prefix="<bos>", stop_words=("<｜hy_eos｜>",), thought=("<think>", "</think>"), reasoning=True, replace_eos=True),
    "deepseekcoder": Template("", user="### Instruction:\n{{content}}\n### Response:", assistant="\n{{content}}\n<|EOT|>\n", prefix="<bos>", default_system="You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, and you only answer questions related to computer science. For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n"),
    "default": Template("", user="Human: {{content}}<eos>\nAssistant:", assistant="{{content}}<eos>\n", system="System: {{content}}<eos>\n", replace_jinja=True),
    "dots_ocr": Template("", user="<|user|>{{content}}<|endofuser|><|assistant|>", assistant="{{content}}<|endofassistant|>", system="<|system|>{{content}}<|endofsystem|>\n", stop_words=("<|endofassistant|>",), efficient_eos=True, media="qwen2_vl"),
    "empty": Template("", assistant="{{content}}"),
    "ernie": Template("", user="<|im_start|>user\n{{content}}<|im_end|>\n\n<|im_start|>assistant\n", assistant="{{content}}<|im_end|>\n\n", system="<|im_start|>system\n{{content}}<|im_end|>\n\n", observation="<|im_start|>tool\n{{content}}<|im_end|>\n\n<|im_start|>assistant\n", default_system="<global_setting>\nthink_mode=True\n</global_setting>", stop_words=("<|im_end|>",)),
    "ernie_nothink": Template("", user="User: {{content}}\nAssistant: ", assistant="{{content}}<|end_of_sentence|>", system="{{content}}\n", prefix="<|begin_of_sentence|>", stop_words=("<|end_of_sentence|>",)),
    "ernie_vl": Template("", user="User: {{content}}", assistant="\nAssistant: {{content}}<|end_of_sentence|>", system="{{content}}\n", stop_words=("<|end_of_sentence|>",), reasoning=True, replace_eos=True, replace_jinja=True, media="ernie_vl"),
    "exaone": Template("", user="[|user|]{{content}}\n[|assistant|]", assistant="{{content}}<eos>\n", system="[|system|]{{content}}[|endofturn|]\n"),
    "falcon": Template("", user="User: {{content}}\nFalcon:", assistant="{{content}}\n", efficient_eos=True),
    "falcon_h1": replace(_CHATML_TOOL, prefix="<bos>", stop_words=("<|im_end|>", "<|end_of_text|>")),
    "fewshot": Template("", assistant="{{content}}\n\n", efficient_eos=True, replace_jinja=True),
    "gemma": _GEMMA,
    "gemma2": replace(_GEMMA, stop_words=("<eos>", "<end_of_turn>"), replace_eos=False, efficient_eos=True),
    "gemma3": replace(_GEMMA, media="gemma3"),
    "gemma3n": replace(_GEMMA, media="gemma3n"),
    "gemma4": _GEMMA4,
    "gemma4n": _GEMMA4,
    "glm4": _GLM4,
    "glm4_moe": replace(_GLM4, tool_format="glm4_moe", reasoning=True),
    "glm4v": replace(_GLM4, stop_words=("<|user|>", "<|observation|>", "</answer>"), reasoning=True, media="glm4v"),
    "glm4_5v": replace(_GLM4, tool_format="glm4_moe", stop_words=("<|user|>", "<|observation|>", "</answer>"), reasoning=True, media="glm4v"),
    "glm_ocr": replace(_GLM4, media="glm4v"),
    "glm4_7": replace(_GLM4, tool_format="glm4_moe", thought=("<think>", "</think>"), reasoning=True, closing_only=True),
    "glmz1": replace(_GLM4, reasoning=True),
    "gpt_oss": Template("", user="<|start|>user<|message|>{{content}}<|end|><|start|>assistant", assistant="{{content}}", system="<|start|>system<|message|>{{content}}<|end|>", default_system="You are ChatGPT, a large language model trained by OpenAI.", thought=("<|channel|>analysis<|message|>", "<|end|><|start|>assistant<|channel|>final<|message|>"), reasoning=True, efficient_eos=True),
    "granite3": _GRANITE,
    "granite3_vision": Template("", user="<|user|>\n{{content}}\n<|assistant|>\n", system="<|system|>\n{{content}}\n", default_system=_CURIOUS, media="llava_next"),
    "granite4": replace(_GRANITE, observation="<|start_of_role|>tool<|end_of_role|>{{content}}<|end_of_text|>\n<|start_of_role|>assistant\n", default_system="You are Granite, developed by IBM. You are a helpful AI assistant.", stop_words=("<|end_of_text|>",)),
    "index": Template("", user="reserved_0{{content}}reserved_1", system="<unk>{{content}}", efficient_eos=True),
    "hunyuan": Template("", user="{{content}}<|extra_0|>", assistant="{{content}}<|eos|>", system="{{content}}<|extra_4|>", prefix="<|startoftext|>", stop_words=("<|eos|>",)),
    "hunyuan_small": Template("", user="<｜hy_User｜>{{content}}<｜hy_place▁holder▁no▁8｜>", assistant="{{content}}<｜hy_place▁holder▁no▁2｜>", system="{{content}}<｜hy_place▁holder▁no▁3｜>", prefix="<｜hy_begin▁of▁sentence｜>", stop_words=("<｜hy_place▁holder▁no▁2｜>",)),
    "hy_dense_1_8b": Template("", user="<｜hy_User｜>{{content}}", assistant="<｜hy_Assistant｜>{{content}}", system="{{content}}<｜hy_place▁holder▁no▁3｜>", prefix="<bos>", stop_words=("<｜hy_place▁holder▁no▁2｜>",), efficient_eos=True),
    "hy_dense_7b": Template("", user="{{content}}<|extra_0|>", assistant="{{content}}", system="{{content}}<|extra_4|>", prefix="<bos>", stop_words=("<|eos|>",), efficient_eos=True),
    "intern2": replace(_CHATML, prefix="<bos>", default_system="You are an AI assistant whose name is InternLM (书生·浦语).\n- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n- InternLM (书生·浦语) can understand and communicate fluently in the language chosen by the user such as English and 中文."),
    "intern_vl": replace(_CHATML, prefix="<bos>", default_system="你是书生·万象，英文名是InternVL，是由上海人工智能实验室、清华大学及多家合作单位联合开发的多模态大语言模型。", media="intern_vl"),
    "intern_s1": replace(_CHATML, prefix="<bos>", media="intern_vl"),
    "keye_vl": replace(_QWEN, reasoning=True, media="qwen2_vl"),
    "kimi_vl": replace(_MOONLIGHT, default_system="You are a helpful assistant", thought=("◁think▷", "◁/think▷"), reasoning=True, media="kimi_vl"),
    "lfm2": replace(_LFM2, default_system="You are a helpful AI assistant."),
    "lfm2_vl": replace(_LFM2, default_system="You are a helpful multimodal assistant by Liquid AI.", media="lfm2_vl"),
    "llama2": _LLAMA2,
    "llama2_zh": replace(_LLAMA2, default_system="You are a helpful assistant. 你是一个乐于助人的助手。"),
    "llama3": _LLAMA3,
    "llama4": Template("", user="<|header_start|>user<|header_end|>\n\n{{content}}<|eot|><|header_start|>assistant<|header_end|>\n\n", assistant="{{content}}<|eot|>", system="<|header_start|>system<|header_end|>\n\n{{content}}<|eot|>", observation="<|header_start|>ipython<|header_end|>\n\n{{content}}<|eot|><|header_start|>assistant<|header_end|>\n\n", prefix="<bos>", stop_words=("<|eot|>", "<|eom|>"), tool_format="llama3", replace_eos=True, media="llama4"),
    "mllama": replace(_LLAMA3, media="mllama"),
    "moonlight": replace(_MOONLIGHT, default_system="You are a helpful assistant provided by Moonshot-AI.", replace_eos=True),
    "llava": replace(_VICUNA, media="llava"),
    "llava_next": replace(_VICUNA, media="llava_next"),
    "llava_next_llama3": replace(_LLAMA3, media="llava_next"),
    "llava_next_mistral": replace(_MISTRAL, media="llava_next"),
    "llava_next_qwen": replace(_QWEN, default_system=_HELPFUL, media="llava_next"),
    "llava_next_yi": replace(_CHATML, media="llava_next"),
    "llava_next_video": replace(_VICUNA, media="llava_next_video"),
    "llava_next_video_mistral": replace(_MISTRAL, media="llava_next_video"),
    "llava_next_video_yi": replace(_CHATML, media="llava_next_video"),
    "mimo": replace(_QWEN, default_system=_HELPFUL, reasoning=True),
    "mimo_v2": replace(_QWEN, default_system="You are MiMo, a helpful AI assistant engineered by Xiaomi.", thought=("<think>", "</think>"), reasoning=True),
    "mimo_vl": replace(_QWEN, default_system="You are MiMo, an AI assistant developed by Xiaomi.", reasoning=True, media="qwen2_vl"),
    "minicpm_v": replace(_CHATML, default_system=_HELPFUL, media="minicpm_v"),
    "minicpm_v_4_6": replace(_CHATML, default_system=_HELPFUL, media="minicpm_v_4_6"),
    "minicpm_o": replace(_CHATML, default_system="You are a helpful assistant. You can accept audio and text input and output voice and text.", media="minicpm_v"),
    "minimax1": Template("", user="<beginning_of_sentence>user name=user\n{{content}}<end_of_sentence>\n<beginning_of_sentence>ai name=assistant\n", assistant="{{content}}<end_of_sentence>\n", system="<beginning_of_sentence>system ai_setting=assistant\n{{content}}<end_of_sentence>\n", observation="<beginning_of_sentence>tool name=tools\n{{content}}<end_of_sentence>\n<beginning_of_sentence>ai name=assistant\n", default_system=_HELPFUL, stop_words=("<end_of_sentence>",), tool_format="minimax1"),
    "minimax2": Template("", user="]~b]user\n{{content}}[e~[\n]~b]ai\n", assistant="{{content}}[e~[\n", system="]~!b[]~b]system\n{{content}}[e~[\n", observation="]~b]tool\n<response>{{content}}</response>[e~[\n]~b]ai\n", default_system="You are a helpful assistant. Your name is MiniMax-M2.1 and is built by MiniMax.", stop_words=("[e~[",), tool_format="minimax2", reasoning=True),
    "ministral": _MINISTRAL,
    "mistral": _MISTRAL,
    "mistral_small": replace(_MINISTRAL, system="[SYSTEM_PROMPT]{{content}}[/SYSTEM_PROMPT]", system_in_user=False, media="pixtral"),
    "ministral3": replace(_MINISTRAL, media="pixtral"),
    "olmo": Template("", user="<|user|>\n{{content}}<|assistant|>\n", prefix="<eos>"),
    "openchat": Template("", user="GPT4 Correct User: {{content}}<eos>GPT4 Correct Assistant:", prefix="<bos>"),
    "openchat-3.6": Template("", user="<|start_header_id|>GPT4 Correct User<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>GPT4 Correct Assistant<|end_header_id|>\n\n", prefix="<bos>", stop_words=("<|eot_id|>",)),
    "opencoder": replace(_CHATML_TOOL, default_system="You are OpenCoder, created by OpenCoder Team."),
    "paligemma": Template("", user="{{content}}\n", prefix="<bos>", system_in_user=True, media="paligemma"),
    "paligemma_chat": replace(_GEMMA, system="{{content}}", media="paligemma"),
    "phi": _PHI,
    "phi_small": replace(_PHI, prefix="<|endoftext|>"),
    "phi4": Template("", user="<|im_start|>user<|im_sep|>{{content}}<|im_end|><|im_start|>assistant<|im_sep|>", assistant="{{content}}<|im_end|>", system="<|im_start|>system<|im_sep|>{{content}}<|im_end|>", stop_words=("<|im_end|>",), replace_eos=True),
    "phi4_mini": Template("", user="<|user|>{{content}}<|end|><|assistant|>", assistant="{{content}}<|end|>", system="<|system|>{{content}}<|end|>", tools="<|tool|>{{content}}<|/tool|>", stop_words=("<|end|>",), replace_eos=True, tool_format=""),
    "pixtral": replace(_MINISTRAL, media="pixtral"),
    "qwen": replace(_QWEN, default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant."),
    "qwen3": replace(_QWEN, reasoning=True),
    "qwen3_nothink": _QWEN,
    "qwen2_audio": replace(_CHATML, default_system=_HELPFUL, replace_eos=True, media="qwen2_audio"),
    "qwen2_omni": replace(_QWEN, default_system=_HELPFUL, media="qwen2_omni"),
    "qwen3_omni": replace(_QWEN, reasoning=True, media="qwen2_omni"),
    "qwen3_omni_nothink": replace(_QWEN, media="qwen2_omni"),
    "qwen2_vl": replace(_QWEN, default_system=_HELPFUL, media="qwen2_vl"),
    "qwen3_vl": replace(_QWEN, reasoning=True, media="qwen3_vl"),
    "qwen3_vl_nothink": replace(_QWEN, media="qwen3_vl"),
    "qwen3_5": replace(_QWEN, tool_format="qwen3_5", reasoning=True, media="qwen3_vl"),
    "qwen3_5_nothink": replace(_QWEN, tool_format="qwen3_5", media="qwen3_vl"),
    "qwen3_6": replace(_QWEN, tool_format="qwen3_5", reasoning=True, media="qwen3_vl"),
    "sailor": replace(_CHATML, user="<|im_start|>question\n{{content}}<|im_end|>\n<|im_start|>answer\n", default_system="You are an AI assistant named Sailor created by Sea AI Lab. Your answer should be friendly, unbiased, faithful, informative and detailed."),
    "seed_coder": replace(_SEED, default_system="You are an AI programming assistant, utilizing the Seed-Coder model, developed by ByteDance Seed, and you only answer questions related to computer science. For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n\n"),
    "seed_oss": replace(_SEED, function="<bos>\n{{content}}<eos>", tool_format="seed_oss", thought=("<seed:think>", "</seed:think>"), reasoning=True),
    "smollm": _CHATML,
    "smollm2": replace(_CHATML, default_system="You are a helpful AI assistant named SmolLM, trained by Hugging Face."),
    "solar": Template("", user="### User:\n{{content}}\n\n### Assistant:\n", system="### System:\n{{content}}\n\n", efficient_eos=True),
    "starchat": Template("", user="<|user|>\n{{content}}<|end|>\n<|assistant|>", assistant="{{content}}<|end|>\n", system="<|system|>\n{{content}}<|end|>\n", stop_words=("<|end|>",)),
    "telechat2": Template("", user="<_user>{{content}}<_bot>", system="<_system>{{content}}", default_system="你是中国电信星辰语义大模型，英文名是TeleChat，你是由中电信人工智能科技有限公司和中国电信人工智能研究院（TeleAI）研发的人工智能助手。"),
    "vicuna": replace(_VICUNA, replace_jinja=True),
    "video_llava": replace(_VICUNA, media="video_llava"),
    "xuanyuan": Template("", user="Human: {{content}} Assistant:", default_system="以下是用户和人工智能助手之间的对话。用户以Human开头，人工智能助手以Assistant开头，会对人类提出的问题给出有帮助、高质量、详细和礼貌的回答，并且总是拒绝参与与不道德、不安全、有争议、政治敏感等相关的话题、问题和指示。\n"),
    "yi": _CHATML,
    "yi_vl": Template("", user="### Human: {{content}}\n### Assistant:", assistant="{{content}}\n", default_system="This is a chat between an inquisitive human and an AI assistant. Assume the role of the AI assistant. Read all the images carefully, and respond to the human's questions with informative, helpful, detailed and polite answers. 这是一个好奇的人类和一个人工智能助手之间的对话。假设你扮演这个AI助手的角色。仔细阅读所有的图像，并对人类的问题做出信息丰富、有帮助、详细的和礼貌的回答。\n\n", stop_words=("###",), efficient_eos=True, media="llava"),
    "youtu": Template("", user="<|User|>{{content}}<|Assistant|>", assistant="{{content}}<|end_of_text|>", observation="<tool_response>\n{{content}}\n</tool_response><|Assistant|>", function="{{content}}", prefix="<bos>", stop_words=("<|end_of_text|>",), reasoning=True, replace_eos=True),
    "youtu_vl": Template("", user="<|begin_of_text|>user\n{{content}}<|end_of_text|>\n<|begin_of_text|>assistant\n", assistant="{{content}}<|end_of_text|>\n", system="<|begin_of_text|>system\n{{content}}<|end_of_text|>\n", default_system=_HELPFUL, stop_words=("<|end_of_text|>",), media="youtu_vl"),
    "yuan": Template("", user="{{content}}<sep>", assistant="{{content}}<eod>\n", stop_words=("<eod>",)),
    "zephyr": Template("", user="<|user|>\n{{content}}<eos><|assistant|>\n", system="<|system|>\n{{content}}<eos>", default_system="You are Zephyr, a helpful assistant."),
    "aeva": replace(_GLM4, tool_format="glm4_moe", default_system="You are an AI assistant named Aeva created by Zongzhi Lou. Your answer should be friendly, unbiased, faithful, informative and detailed.", thought=("<think>", "</think>"), reasoning=True, closing_only=True),
}


def _named(name: str, t: Template) -> Template:
    """With the defaults that follow from other fields: an answer has no end token of its own where the
    encoder adds it."""
    plain = replace(t, name=name)
    if t.efficient_eos and t.assistant == "{{content}}<eos>":
        plain = replace(plain, assistant="{{content}}")
    return plain


TEMPLATES: dict[str, Template] = {n: _named(n, t) for n, t in _ALL.items()}
