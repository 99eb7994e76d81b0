"""Word lists and constants of the default rank profile."""

from __future__ import annotations

# ---- Fixed values: results depend on each of them. ----

STRONG_TITLES = [
    "ml engineer", "machine learning engineer", "ai engineer", "applied (?:ml |ai )?scientist", "ai research(?:er| engineer)?",
    "research engineer", "data scientist", "ml scientist", "nlp engineer", "ml ?ops engineer", "deep learning", "staff ml",
    "senior ml", "senior ai", "ai specialist", "search engineer", "relevance engineer", "recommendation engineer",
]
ADJACENT_TITLES = ["data engineer", "senior data engineer", "analytics engineer", "backend engineer", "software engineer", "full[- ]?stack", "sde", "platform engineer", "developer", "programmer"]
NONTECH_PREFIXES = [
    "human resource", "recruit", "talent acquisition", "marketing", "content", "writer", "graphic", "design", "account", "finance",
    "financial", "mechanical", "operations", "teacher", "nurse", "doctor", "lawyer", "business analyst", "administrat",
    "product manager", "project manager", "consultant",
]
NONTECH_WORDS = ["hr", "sales", "civil", "customer", "support", "executive"]
AREAS = {
    "retrieval_embeddings": ["embeddings?", "dense retrieval", "semantic search", "sentence[- ]transformer", "bge", "e5", "vector search", "nearest neighbor", "ann", "knn", "faiss", "pinecone", "weaviate", "qdrant", "milvus"],
    "ranking_ltr": ["ranking", "re-?rank", "learning to rank", "ltr", "ndcg", "mrr", "relevance tuning", "search relevance", "search quality"],
    "recommendation": ["recommend", "recommender", "recommendation", "recsys", "personali[sz]ation", "collaborative filtering", "matching engine"],
    "search_ir": ["information retrieval", "inverted index", "bm25", "elasticsearch", "opensearch", "lucene", "solr", "query understanding", "hybrid search", "full[- ]text search"],
    "applied_ml_prod": ["deployed", "in production", "productioni[sz]ed", "served", "serving", "model serving", "trained and deployed", "shipped a model", "ml pipeline", "feature store", "a/b test", "online metric"],
}
IR_AREAS = ["retrieval_embeddings", "ranking_ltr", "recommendation", "search_ir"]
NLP_IR = ["nlp", "natural language", "information retrieval", "text ranking", "search relevance", "recommend", "recommender", "language model", "word embedding", "tf-?idf", "question answering", "query understanding", "semantic search", "retrieval"]
VISION_SPEECH_ROBOTICS = ["computer vision", "image classification", "object detection", "segmentation", "opencv", "speech recognition", "tts", "asr", "text-to-speech", "robotics", "slam", "lidar", "autonomous", "point cloud", "sensor fusion"]
BUILD_VERBS = ["built", "build", "shipped", "deployed", "implemented", "developed", "engineered", "wrote", "coded", "production", "launched", "delivered", "owned"]
LEAD_WORDS = ["architect", "tech lead", "technical lead", "engineering manager", "head of", "director", "principal architect", "leadership", "strategy", "roadmap", "stakeholder"]
TIER1_CITIES = ["pune", "noida", "hyderabad", "mumbai", "delhi", "gurgaon", "gurugram", "bangalore", "bengaluru"]
AI_SKILLS = [
    "bert", "computer vision", "data science", "deep learning", "embeddings", "fine-tuning llms", "generative ai", "gpt",
    "hugging face", "huggingface", "image classification", "information retrieval", "keras", "langchain", "large language models",
    "llm", "llms", "lora", "machine learning", "mlops", "natural language processing", "neural networks", "nlp", "object detection",
    "opencv", "prompt engineering", "pytorch", "rag", "recommender systems", "reinforcement learning", "scikit-learn",
    "semantic search", "speech recognition", "stable diffusion", "tensorflow", "transformers", "tts", "xgboost",
]
RESEARCH = ["phd", "postdoc", "published", "publication", "peer-reviewed", "research paper", "neurips", "icml", "acl", "cvpr", "thesis", "dissertation", "academic"]
LANGCHAIN = ["langchain", "llama[- ]?index", "openai api", "gpt-4", "prompt engineering"]
CLASSICAL_ML = ["scikit", "sklearn", "xgboost", "lightgbm", "random forest", "logistic regression", "svm", "gradient boosting", "feature engineering", "classical ml", "statistical model"]

#: Composite features in order, with their default weights.
WEIGHTS = {
    "role_substance": 0.23, "skill_corroboration": 0.07125, "experience_band": 0.0890625, "nlp_ir_signal": 0.0890625,
    "product_vs_consulting": 0.0890625, "production_recency": 0.0534375, "tenure_stability": 0.0534375,
    "external_validation": 0.035625, "location_fit": 0.0890625, "ce_score": 0.10, "semantic_sim": 0.10,
}
RUBRIC_WEIGHTS = {"role_substance": 35, "experience_band": 10, "nlp_ir": 10, "product_company": 10, "production_recency": 5, "tenure_stability": 5, "external_validation": 5, "location": 10}
REFERENCE_DATE = "2026-06-16"
SEED = 42
