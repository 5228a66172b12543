"""Schemas of the model's tables and of the feeds' payloads; nothing is inferred."""

POSTING = "id string, title string, description string, raw_content string, company string, location string, link string, status string, tags string, published_at timestamp, created_at timestamp, source_id string"
SOURCE = "id string, name string, source_type string, url string, metadata string, created_at timestamp"
APPLICATION = "id string, job_id string, channel string, status string, kind string, resume_version string, sent_at timestamp, replied_at timestamp, interview_at timestamp, notes string"
SCORE_EVENT = "id string, at timestamp, type string, points int, note string, application_id string"
METADATA = "lastMessageId bigint, lastItemId string, lastHashes array<string>, emptyRuns int, stopUntil timestamp, inactive boolean, inactiveUntil timestamp, inactiveReason string, blockStrikes int, lastError string, lastScrapedAt timestamp, maxItems int, feedRemoved boolean"

# One element of each feed's list.
REMOTIVE = "id bigint, url string, title string, company_name string, category string, tags array<string>, job_type string, publication_date string, candidate_required_location string, salary string, description string"
ARBEITNOW = "slug string, company_name string, title string, description string, remote boolean, url string, tags array<string>, job_types array<string>, location string, created_at bigint"
THEMUSE = "id bigint, name string, contents string, publication_date string, locations array<struct<name:string>>, categories array<struct<name:string>>, levels array<struct<name:string>>, company struct<name:string>, refs struct<landing_page:string>"
REMOTEOK = "id string, epoch bigint, date string, company string, position string, tags array<string>, description string, location string, url string, salary_min bigint, salary_max bigint"
JOBICY = "id bigint, url string, jobTitle string, companyName string, jobIndustry array<string>, jobType array<string>, jobGeo string, jobLevel string, jobExcerpt string, jobDescription string, pubDate string, annualSalaryMin string, annualSalaryMax string, salaryCurrency string"
FINDWORK = "id bigint, role string, company_name string, employment_type string, location string, remote boolean, url string, text string, date_posted string, keywords array<string>"
DEVIT = "_id string, name string, company string, companyType string, companySize string, jobUrl string, redirectJobUrl string, activeFrom string, actualCity string, cityCategory string, techCategory string, workplace string, remoteType string, jobType string, expLevel string, technologies array<string>, description string, responsibilitiesTextArea string, requirementsMustTextArea string"
ARBEIT_LIST = "refnr string, titel string, beruf string, arbeitgeber string, arbeitsort struct<ort:string,region:string,land:string>, aktuelleVeroeffentlichungsdatum string"
ARBEIT_DETAIL = "stellenangebotsTitel string, hauptberuf string, stellenangebotsBeschreibung string, firma string, stellenlokationen array<struct<adresse:struct<ort:string>>>, veroeffentlichungszeitraum struct<von:string>, datumErsteVeroeffentlichung string, arbeitgeberKundennummerHash string"
